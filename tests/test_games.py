"""Games are found and load their replays by name."""

import sys
from importlib.metadata import EntryPoint

import pytest

from boutline.functions import games


def test_discovery(monkeypatch, tmp_path):
    assert {"platform_fighter", "text_pad"} <= set(games.available())
    (tmp_path / "other_game.py").write_text("from boutline.functions.games import Game, register\nregister(Game(name='other', busy={}, categories={}))\n")
    (tmp_path / "bad_game.py").write_text("import no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(games, "entry_points", lambda group: [EntryPoint("b", "bad_game", group), EntryPoint("o", "other_game:GAME", group)])
    assert games.get("other").name == "other" and "other" in games.available()
    with pytest.raises(KeyError, match="bad_game failed"):
        games.get("chess")
    for d in (games._GAMES.pop("other"), games.BROKEN.pop("bad_game")):
        assert d
    sys.modules.pop("other_game", None)


def test_load(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.pad").write_text("1 0 3\n5 1 8\n")
    (tmp_path / "two.pad").write_text("2 0 1\n")
    (tmp_path / "note.txt").write_text("no replay")
    game = games.get("text_pad")
    rows = game.load(spark, str(tmp_path), bytes_each=1)
    assert sorted((r.path.rsplit("/")[-1], r.frame, r.slot, r.state) for r in rows.collect()) == [("one.pad", 1, 0, 3), ("one.pad", 5, 1, 8), ("two.pad", 2, 0, 1)]
    assert rows.rdd.getNumPartitions() == 2
    (tmp_path / "broken.pad").write_text("1 0 3\nx")
    assert game.load(spark, f"file://{tmp_path}", on_error="skip").count() == 3
    with pytest.raises(Exception, match="not enough values"):
        game.load(spark, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    assert game.load(spark, str(tmp_path / "none")).count() == 0
    assert [tuple(r) for r in game.input_bits(spark).collect()][3] == (3, "Fire") and game.replay_folders("linux") and game.replay_folders("other") == ()
    with pytest.raises(ValueError, match="no loader"):
        games.get("platform_fighter").load(spark, str(tmp_path))
