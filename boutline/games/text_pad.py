"""A game whose replays are text: one line ``frame slot held`` for each change of a pad, where ``held`` has one bit a button."""

from boutline.functions.games import Game, register
from boutline.sources.replays import ReplaySource


class TextPadSource(ReplaySource):
    """Replays of the game as a table."""

    @classmethod
    def name(cls) -> str:
        return "text_pad"

    def schema(self) -> str:
        return "path string, frame long, slot int, state int"

    def parse(self, path: str, content: bytes):
        for line in content.decode().splitlines():
            frame, slot, held = line.split()
            yield path, int(frame), int(slot), int(held)


register(Game(
    name="text_pad", display_name="Text Pad", busy={"Fire": 10}, categories={"attack": ("Fire",), "movement": ("Up", "Down", "Left")}, extension=".pad",
    source=TextPadSource, bits={0: "Up", 1: "Down", 2: "Left", 3: "Fire"}, replay_paths={"linux": ("~/text_pad/replays",)}, pressure_action="Fire", tracked=("Fire", "Up")))
