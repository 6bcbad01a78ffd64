"""What a game must declare so that the shared operators can run on it."""

import importlib
import pkgutil
import sys
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

GROUP = "boutline.games"  # of entry points, and the package whose modules are games


@dataclass(frozen=True)
class Game:
    """Vocabulary, timing and loader of one game. ``busy`` holds frames per action; actions without an entry take none. ``source`` is the data
    source class that reads its replays, ``bits`` the action of each bit of an input state."""

    name: str
    busy: dict[str, int]
    categories: dict[str, tuple[str, ...]]
    fps: int = 60
    extension: str = ".replay"
    character_noun: str = "Character"
    pressure_action: str | None = None
    tracked: tuple[str, ...] = field(default_factory=tuple)
    display_name: str | None = None
    source: type | None = None
    bits: dict[int, str] = field(default_factory=dict)
    replay_paths: dict[str, tuple[str, ...]] = field(default_factory=dict)  # by platform
    replay_help: str = "Look up the replay folder in the game's own replay browser."

    def load(self, spark: SparkSession, folder: str, **options) -> DataFrame:
        """The game's replays below ``folder``, in the schema of its source."""
        if self.source is None:
            raise ValueError(f"{self.name} has no loader. {self.replay_help}")
        spark.dataSource.register(self.source)
        return spark.read.format(self.source.name()).option("extension", self.extension).options(**options).load(folder)

    def input_bits(self, spark: SparkSession) -> DataFrame:
        """The bits of an input state as a table (bit, action)."""
        return spark.createDataFrame(sorted(self.bits.items()), "bit int, action string")

    def replay_folders(self, platform: str = sys.platform) -> tuple[str, ...]:
        return self.replay_paths.get(platform, ())

    def actions(self, spark: SparkSession) -> DataFrame:
        """The action model as a table (action, busy, category): a handful of rows per game."""
        group = {a: c for c, names in self.categories.items() for a in names}
        rows = [(a, self.busy.get(a, 0), group.get(a)) for a in sorted(set(group) | set(self.busy))]
        return spark.createDataFrame(rows, "action string, busy int, category string")


_GAMES: dict[str, Game] = {}


def register(game: Game) -> Game:
    _GAMES[game.name] = game
    return game


BROKEN: dict[str, str] = {}  # modules that could not be imported, and why
_sought: set[str] = set()


def discover() -> None:
    """Imports every module of the games package and every entry point of the group, so that it registers its game. One that fails is
    named in BROKEN and hides no other."""
    package = importlib.import_module(GROUP)
    places = {f"{GROUP}.{m.name}" for m in pkgutil.iter_modules(package.__path__)} | {e.value.partition(":")[0] for e in entry_points(group=GROUP)}
    for name in sorted(places - _sought):
        _sought.add(name)
        try:
            importlib.import_module(name)
        except Exception as e:
            BROKEN[name] = f"{type(e).__name__}: {e}"


def available() -> list[str]:
    discover()
    return sorted(_GAMES)


def get(name: str) -> Game:
    if name not in _GAMES:
        discover()
    if name not in _GAMES:
        failed = "; ".join(f"{k} failed ({v})" for k, v in BROKEN.items())
        raise KeyError(f"unknown game {name!r}; available: {', '.join(sorted(_GAMES)) or 'none'}" + (f"; {failed}" if failed else ""))
    return _GAMES[name]


# fixed values: frames an action occupies the player, and the groups reported
register(Game(
    name="platform_fighter", busy={"Dodge": 14},
    categories={"attack": ("Light", "Heavy"), "movement": ("Left", "Right"), "defence": ("Dodge",), "mobility": ("Jump", "UpJump"), "utility": ("ThrowPickup",)},
    character_noun="Legend", pressure_action="Dodge", tracked=("Dodge", "Light", "Heavy", "Jump", "UpJump")))
