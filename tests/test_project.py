import json
import sqlite3

import pytest

from tidemill import Adapter, Column, Dashboard, DatabaseSource, FileSource, LocalFiles, Model, Project, Query, Sqlite
from tidemill.errors import LineageError, RunFailed, SpecError, UnknownName
from tidemill.plans.project import Runner

MOVES = [{"game": g, "ply": n, "player": "white" if n % 2 else "black", "clock": 60 - 7 * n} for g, plies in ((1, 5), (2, 2), (3, 1)) for n in range(1, plies + 1)]
GAMES = "SELECT game, player, COUNT(*) AS plies, MIN(clock) AS least FROM moves GROUP BY game, player HAVING COUNT(*) > 1"
LADDER = """
SELECT player, rating, RANK() OVER (ORDER BY rating DESC) AS place FROM players p
WHERE EXISTS (SELECT 1 FROM board.games g WHERE g.player = p.player)
"""
DEBTS = """
WITH open_fees AS (SELECT player, due FROM fees WHERE settled = 0)
SELECT player, SUM(due) AS owed FROM open_fees GROUP BY player UNION ALL SELECT 'club', SUM(due) FROM open_fees
"""


@pytest.fixture
def project(tmp_path):
    (tmp_path / "players.csv").write_text("player,rating\nwhite,1500\nblack,1720\nred,1900\n")
    (tmp_path / "moves_array.json").write_text(json.dumps(MOVES[:3]))
    (tmp_path / "moves_lines.json").write_text("\n".join(map(json.dumps, MOVES[3:])))
    db = sqlite3.connect(tmp_path / "club.db")
    db.execute("CREATE TABLE fees (player TEXT, due REAL, settled INTEGER)")
    db.executemany("INSERT INTO fees VALUES (?,?,?)", [("red", 20.0, 0), ("red", 5.5, 0), ("white", 8.0, 1), ("black", 3.0, 0)])
    db.commit()
    db.close()
    return (
        Project()
        .connect("files", LocalFiles(str(tmp_path)))
        .connect("db", Sqlite(str(tmp_path / "club.db")))
        .add(
            Adapter("players", "files", FileSource("players.csv")),
            Adapter("moves", "files", FileSource("moves_*.json", "json")),
            Adapter("fees", "db", DatabaseSource("fees")),
            Model("board.games", GAMES),
            Model("board.ladder", LADDER),
            Model("club.debts", DEBTS),
            Query("first", "SELECT player, place FROM board.ladder ORDER BY place LIMIT 2"),
            Query("debts", "SELECT * FROM club.debts ORDER BY owed DESC"),
            Dashboard("debts", "debts", "bar", "player", "owed"),
        )
    )


@pytest.fixture
def runner(spark, project, tmp_path):
    runner = Runner(spark, project, str(tmp_path / "store"), state=f"state_{tmp_path.name.replace('-', '_')}")
    yield runner
    for table in (*project.adapters, *project.models):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def phases(records):
    return {r["task"]: r["phase"] for r in records}


def test_full_run(spark, runner):
    records = runner.run()
    assert set(phases(records).values()) == {"completed"} and len(records) == 6
    assert runner.query("first").collect() == [("black", 1), ("white", 2)]
    assert sorted(map(tuple, spark.table("board.games").collect())) == [(1, "black", 2, 32), (1, "white", 3, 25)]
    assert [tuple(r) for r in runner.dashboard("debts").collect()] == [("club", 28.5, None), ("red", 25.5, None), ("black", 3.0, None)]
    assert runner.run_log().where("phase = 'completed'").count() == 6
    fresh = {r.name: r.updated_at for r in runner.freshness().collect()}
    assert fresh["board.ladder"] == min(fresh["players"], fresh["moves"])
    oldest = {r.name: r.oldest_input_at for r in runner.oldest_inputs().collect()}
    assert oldest["club.debts"] == fresh["fees"]


def test_target_runs_only_its_inputs(spark, runner):
    assert set(phases(runner.run_target("club.debts"))) == {"fees", "club.debts"}
    assert not spark.catalog.tableExists("board.ladder")
    with pytest.raises(UnknownName):
        runner.run_target("nothing")


def test_only_what_changed_is_rebuilt(runner, project):
    assert len(runner.run_changed()) == 6
    assert runner.run_changed() == []
    project.add(Model("board.games", GAMES, "only the description differs"))
    assert runner.run_changed() == []
    project.add(Model("board.games", GAMES.replace("> 1", "> 2")))
    assert set(phases(runner.run_changed())) == {"board.games", "board.ladder"}
    assert runner.query("first").collect() == [("white", 1)]
    players = project.adapters["players"]
    project.add(Adapter("players", "files", players.source, (Column("player", "STRING"), Column("rating", "INTEGER"))))
    assert set(phases(runner.run_changed())) == {"players", "board.ladder"}
    del project.models["club.debts"]
    assert runner.run_changed() == []


def test_a_declaration_makes_everything_downstream_stale(runner):
    runner.run()
    runner.declare(Model("board.games", GAMES.replace("> 1", "> 2")))
    fresh = {r.name: r.updated_at for r in runner.freshness().collect()}
    assert {n for n, at in fresh.items() if at is None} == {"board.games", "board.ladder"}
    assert set(phases(runner.run_changed())) == {"board.games", "board.ladder"}
    assert None not in [r.updated_at for r in runner.freshness().collect()]


def test_removal(spark, runner, project):
    runner.run()
    runner.remove("moves")
    assert "moves" not in project.adapters and not spark.catalog.tableExists("moves")
    fresh = {r.name: r.updated_at for r in runner.freshness().collect()}
    assert "moves" not in fresh and {n for n, at in fresh.items() if at is None} == {"board.games", "board.ladder"}
    with pytest.raises(UnknownName):
        runner.remove("moves")


def test_failure_spreads_downstream_only(spark, runner, project):
    project.add(Model("board.games", "SELECT no_such_column FROM moves"))
    with pytest.raises(RunFailed) as failure:
        runner.run()
    assert phases(failure.value.log) == {
        "players": "completed", "moves": "completed", "fees": "completed",
        "board.games": "failed", "board.ladder": "skipped", "club.debts": "completed",
    }
    assert "1 of 6" in str(failure.value)
    project.add(Model("board.games", GAMES))
    assert set(phases(runner.run_changed())) == {"board.games", "board.ladder"}


def test_progress_is_there_when_a_run_stops_half_way(runner, monkeypatch):
    class Stopped(BaseException):
        pass

    def stop(model):
        raise Stopped

    monkeypatch.setattr(runner, "build_model", stop)
    with pytest.raises(Stopped):
        runner.run_target("board.games")
    seen = {(r.task, r.phase) for r in runner.progress().collect()}
    assert seen == {("moves", "waiting"), ("board.games", "waiting"), ("moves", "running"), ("moves", "completed"), ("board.games", "running")}
    assert runner.run_log().count() == 0


def test_no_match_keeps_the_table_and_its_age(spark, runner, project):
    runner.run()
    before = {r.name: r.updated_at for r in runner.freshness().collect()}
    project.add(Adapter("players", "files", FileSource("gone_*.csv")))
    assert phases(runner.run_target("board.ladder"))["players"] == "no_data"
    assert spark.table("players").count() == 3
    after = {r.name: r.updated_at for r in runner.freshness().collect()}
    assert after["players"] == before["players"] == after["board.ladder"]
    project.add(Adapter("never", "files", FileSource("gone_*.csv")), Model("built_on", "SELECT * FROM never"))
    assert phases(runner.run_target("built_on")) == {"never": "no_data", "built_on": "skipped"}


def test_undeclared_table_and_cycle(runner, project):
    project.add(Model("bad", "SELECT * FROM nowhere"))
    with pytest.raises(LineageError, match="nowhere"):
        runner.run()
    project.add(Model("bad", "SELECT * FROM worse"), Model("worse", "SELECT * FROM bad"))
    with pytest.raises(LineageError, match="each other"):
        runner.run()


def test_unknown_names(runner, project):
    with pytest.raises(UnknownName):
        runner.query("nothing")
    with pytest.raises(UnknownName):
        runner.dashboard("nothing")
    with pytest.raises(UnknownName):
        project.connection("nothing")
    with pytest.raises(SpecError):
        Dashboard("d", "q", "pie", "x", "y")


def test_what_counts_as_a_change():
    base = Adapter("a", "c", FileSource("x.csv"), (Column("id", "BIGINT", "old"),), "text")
    assert base.significant() == Adapter("a", "c", FileSource("x.csv"), (Column("id", "BIGINT", "old"),), "other").significant()
    for other in (
        Adapter("a", "d", base.source, base.columns),
        Adapter("a", "c", FileSource("y.csv"), base.columns),
        Adapter("a", "c", DatabaseSource("x"), base.columns),
        Adapter("a", "c", base.source, (Column("id", "BIGINT", "new"),)),
        Adapter("a", "c", base.source, ()),
    ):
        assert other.significant() != base.significant()
    assert Query("q", "s").significant() != Query("r", "s").significant()
