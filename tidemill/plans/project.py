"""Running a project: sources to tables, models over them, and a log of what happened."""

from __future__ import annotations

import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime, timezone
from graphlib import CycleError, TopologicalSorter

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import LineageError, RunFailed, UnknownName
from tidemill.functions.results import chart_series
from tidemill.operators.freshness import invalidate_downstream, oldest_input
from tidemill.plans.references import EDGE_FIELDS, referenced_tables
from tidemill.plans.tables import append_rows, create_or_replace, drop_table, table_exists
from tidemill.sources.ingest import ingest
from tidemill.specs import Adapter, FileSource, Model, Project
from tidemill.streaming.incremental import forget_loads, load_new

LOG_FIELDS = (
    "run_id string, run_started_at timestamp_ntz, task string, phase string, "
    "started_at timestamp_ntz, completed_at timestamp_ntz, error string"
)
PROGRESS_FIELDS = "run_id string, task string, phase string, at timestamp_ntz, error string"
STATE_FIELDS = "name string, kind string, significant string, inputs array<string>, updated_at timestamp_ntz, completed_at timestamp_ntz"


class Runner:
    """Carries out a project in one session.

    ``location`` is the folder tables are stored below (the warehouse when not given);
    ``state`` is the database with the run log and, one row per adapter or model, what was
    declared when it last completed, its inputs and how fresh it is. ``loads`` is the folder for
    rows and progress of adapters that declare ``max_batch_size`` and are loaded by and by
    (``_loads`` below the location or warehouse when not given).
    """

    def __init__(
        self, spark: SparkSession, project: Project, location: str | None = None, state: str = "tidemill_state", loads: str | None = None
    ):
        self.spark = spark
        self.project = project
        self.location = location
        self.state = state
        self.loads = loads or f"{(location or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/_loads"
        self.parallel_steps = 4

    def load_adapter(self, adapter: Adapter) -> DataFrame | None:
        """Load one source into its table; an empty match leaves the table as it was.

        Files are read once each and their rows added if the adapter declares ``max_batch_size``.
        """
        connection, source = self.project.connection(adapter.connection), adapter.source
        if isinstance(source, FileSource) and source.max_batch_size and isinstance(source.path, str):
            return load_new(self.spark, adapter, connection, self.loads)
        rows = ingest(self.spark, adapter, connection)
        return None if rows is None else create_or_replace(rows, adapter.name, self._place(adapter.name))

    def build_model(self, model: Model) -> DataFrame:
        return create_or_replace(self.spark.sql(model.sql), model.name, self._place(model.name))

    def query(self, name: str) -> DataFrame:
        """A saved query's result."""
        if name not in self.project.queries:
            raise UnknownName(f"query {name!r} is not declared")
        return self.spark.sql(self.project.queries[name].sql)

    def dashboard(self, name: str) -> DataFrame:
        """A dashboard's chart series."""
        if name not in self.project.dashboards:
            raise UnknownName(f"dashboard {name!r} is not declared")
        board = self.project.dashboards[name]
        return chart_series(self.query(board.query), board.x_column, board.y_column)

    def inputs(self) -> dict[str, list[str]]:
        """Per adapter and model the tables it reads; undeclared tables and cycles are errors."""
        declared = {**self.project.adapters, **self.project.models}
        known = {name.lower(): name for name in declared}
        inputs = {name: [] for name in self.project.adapters}
        for model in self.project.models.values():
            tables = referenced_tables(self.spark, model.sql)
            missing = [t for t in tables if t.lower() not in known]
            if missing:
                raise LineageError(f"model {model.name!r} reads undeclared tables: {', '.join(missing)}")
            inputs[model.name] = [known[t.lower()] for t in tables]
        try:
            TopologicalSorter(inputs).prepare()
        except CycleError as error:
            raise LineageError(f"models depend on each other: {' -> '.join(error.args[1])}") from error
        return inputs

    def edges(self) -> DataFrame:
        return self._edge_table(self.inputs())

    def run(self) -> list[dict]:
        """Bring every adapter and model up to date, inputs first."""
        return self._run(set(self.inputs()))

    def run_target(self, target: str) -> list[dict]:
        """Bring one adapter or model up to date, together with all it depends on."""
        inputs = self.inputs()
        if target not in inputs:
            raise UnknownName(f"target {target!r} is not declared")
        needed, todo = {target}, [target]
        while todo:
            new = set(inputs[todo.pop()]) - needed
            needed |= new
            todo += new
        return self._run(needed)

    def run_changed(self) -> list[dict]:
        """Rebuild only what is affected by declarations that changed since they were last run."""
        return self._run(self.affected_nodes())

    def affected_nodes(self) -> set[str]:
        """Declarations that are new, differ from what last completed, or lie downstream of such.

        Declarations are few and in memory, so this is a walk over them; for tables of nodes
        and edges there is ``operators.changes.affected``.
        """
        inputs = self.inputs()
        last = {row.name: (row.kind, row.significant, set(row.inputs)) for row in self.state_table().collect()}
        found = set()
        for name in inputs:
            now = self._declaration(name)
            if last.get(name) != (now["kind"], now["significant"], set(inputs[name])):
                found.add(name)
        for name in TopologicalSorter(inputs).static_order():
            if found & set(inputs[name]):
                found.add(name)
        return found

    def run_log(self) -> DataFrame:
        return self._stored("run_log", LOG_FIELDS)

    def progress(self) -> DataFrame:
        """What each step of each run was doing when, written while the run goes on."""
        return self._stored("progress", PROGRESS_FIELDS)

    def state_table(self) -> DataFrame:
        return self._stored("tables", STATE_FIELDS)

    def freshness(self) -> DataFrame:
        """Per table: adapters when they were loaded, models the age of their oldest input."""
        return self.state_table().select("name", "updated_at")

    def declare(self, spec: Adapter | Model) -> None:
        """Add or change an adapter or model; it and all downstream lose their freshness."""
        self.project.add(spec)
        start = self.spark.createDataFrame([(spec.name,)], "name string")
        fresh = invalidate_downstream(self.freshness(), self.edges(), start)
        state = self.state_table()
        self._replace("tables", state.drop("updated_at").join(fresh, "name").select(state.columns))

    def remove(self, name: str) -> None:
        """Drop an adapter or model with its table and state; what was built on it loses its freshness."""
        if name not in self.project.adapters and name not in self.project.models:
            raise UnknownName(f"{name!r} is not declared")
        edges = self.edges()
        self.project.adapters.pop(name, None)
        self.project.models.pop(name, None)
        start = self.spark.createDataFrame([(name,)], "name string")
        fresh = invalidate_downstream(self.freshness(), edges, start).where(F.col("name") != name)
        state = self.state_table()
        self._replace("tables", state.drop("updated_at").join(fresh, "name").select(state.columns))
        drop_table(self.spark, name)
        forget_loads(self.spark, name, self.loads)

    def oldest_inputs(self) -> DataFrame:
        return oldest_input(self.edges(), self.freshness())

    def _run(self, names: set[str]) -> list[dict]:
        if not names:
            return []
        inputs = self.inputs()
        run_id, started = uuid.uuid4().hex, _now()
        log: dict[str, dict] = {}
        order = TopologicalSorter({name: [i for i in inputs[name] if i in names] for name in names})
        order.prepare()
        step = inheritable_thread_target(self.spark)(self._step)
        self._tell(run_id, [_record(n, "waiting") for n in sorted(names)])
        with ThreadPoolExecutor(self.parallel_steps) as pool:
            running = {}
            while order.is_active():
                news = []
                for name in order.get_ready():
                    # A source without data counts as there if an earlier run left its table.
                    if all(log[i]["phase"] == "completed" or self._has_old_table(log[i]) for i in inputs[name] if i in names):
                        running[pool.submit(step, name)] = name
                        news.append(_record(name, "running", _now()))
                    else:
                        log[name] = _record(name, "skipped")
                        news.append(log[name])
                        order.done(name)
                if news:
                    self._tell(run_id, news)
                if running:
                    ended, _ = wait(running, return_when=FIRST_COMPLETED)
                    for future in ended:
                        name = running.pop(future)
                        log[name] = future.result()
                        order.done(name)
                    self._tell(run_id, [log[f["task"]] for f in (future.result() for future in ended)])
        records = [{"run_id": run_id, "run_started_at": started, **log[name]} for name in log]
        self._remember(records, inputs)
        failed = [r["task"] for r in records if r["phase"] == "failed"]
        if failed:
            raise RunFailed(f"{len(failed)} of {len(records)} steps failed: {', '.join(sorted(failed))}", records)
        return records

    def _step(self, name: str) -> dict:
        started = _now()
        try:
            if name in self.project.adapters:
                if self.load_adapter(self.project.adapters[name]) is None:
                    return _record(name, "no_data", started, _now())
            else:
                self.build_model(self.project.models[name])
        except Exception as error:  # noqa: BLE001 - one failed step must not end the others
            return _record(name, "failed", started, _now(), f"{type(error).__name__}: {error}")
        return _record(name, "completed", started, _now())

    def _has_old_table(self, record) -> bool:
        return record["phase"] == "no_data" and table_exists(self.spark, record["task"])

    def _tell(self, run_id, records) -> None:
        rows = [(run_id, r["task"], r["phase"], r["completed_at"] or r["started_at"] or _now(), r["error"]) for r in records]
        self._append("progress", self.spark.createDataFrame(rows, PROGRESS_FIELDS))

    def _remember(self, records: list[dict], inputs: dict[str, list[str]]) -> None:
        """Log the run and update the state of completed steps.

        A step that failed, was skipped or found no data keeps its earlier state, so it still counts as changed the
        next time; declarations that were dropped leave. Both tables have a row per step.
        """
        self._append("run_log", self.spark.createDataFrame(records, LOG_FIELDS))
        completed = {r["task"]: r["completed_at"] for r in records if r["phase"] == "completed"}
        if not completed:
            return
        state = {row.name: row.asDict() for row in self.state_table().collect() if row.name in inputs}
        for name in TopologicalSorter(inputs).static_order():
            if name not in completed:
                continue
            updated = completed[name]
            if name in self.project.models:
                times = [state[i]["updated_at"] for i in inputs[name] if i in state]
                updated = min((t for t in times if t is not None), default=None)
            state[name] = {**self._declaration(name), "inputs": inputs[name], "updated_at": updated, "completed_at": completed[name]}
        self._replace("tables", self.spark.createDataFrame(list(state.values()), STATE_FIELDS))

    def _declaration(self, name):
        spec = self.project.adapters.get(name) or self.project.models[name]
        return {"name": name, "kind": type(spec).__name__, "significant": spec.significant()}

    def _declared(self):
        rows = [self._declaration(name) for name in (*self.project.adapters, *self.project.models)]
        return self.spark.createDataFrame(rows, "name string, kind string, significant string")

    def _edge_table(self, inputs):
        rows = [(src, dst) for dst, sources in inputs.items() for src in sources]
        return self.spark.createDataFrame(rows, EDGE_FIELDS)

    def _stored(self, name, fields):
        full = f"{self.state}.{name}"
        return self.spark.table(full) if table_exists(self.spark, full) else self.spark.createDataFrame([], fields)

    def _replace(self, name, df):
        full = f"{self.state}.{name}"
        create_or_replace(df.coalesce(1), full, self._place(full))

    def _append(self, name, df):
        full = f"{self.state}.{name}"
        if table_exists(self.spark, full):
            append_rows(df.coalesce(1), full)
        else:
            self._replace(name, df)

    def _place(self, name):
        return f"{self.location.rstrip('/')}/{name}" if self.location else None


def _record(task, phase, started=None, completed=None, error=None):
    return {"task": task, "phase": phase, "started_at": started, "completed_at": completed, "error": error}


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
