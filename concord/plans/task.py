"""Tasks as JSON: an algorithm, its parameters and each party's dataset; results go to the parties that may see them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from enum import Enum

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.catalog import Catalog, Dataset
from concord.files import scratch
from concord.functions import expression
from concord.operators import clean, lookup, psi, stats
from concord.operators.ml import boosting, linear, mlp
from concord.operators.preprocess.pipeline import PreprocessPipeline
from concord.sources import tables
from concord.types import CODE_TYPES, NUMERIC_CODES, Code


class Status(str, Enum):
    RUNNING = "RUNNING"
    SUCCESS = "SUCCESS"
    FAIL = "FAIL"
    NONEXIST = "NONEXIST"
    FINISHED = "FINISHED"


class TaskType(str, Enum):
    """Kinds of tasks; each runs on Spark alike, but only algorithms of its kind."""

    ACTOR = "ACTOR_TASK"
    PSI = "PSI_TASK"
    PIR = "PIR_TASK"
    TEE = "TEE_TASK"


ALGORITHMS: dict[str, Callable] = {}
KINDS: dict[TaskType, tuple[str, ...] | None] = {TaskType.ACTOR: None, TaskType.PSI: ("psi",), TaskType.PIR: ("pir",), TaskType.TEE: ("psi",)}
PLUGINS: dict[tuple[str, str], type] = {}
FUNCTIONS: dict[str, Callable] = {}
# Joint statistics by their number in a task's document.
STATISTICS = {1: "AVG", 2: "SUM", 3: "MAX", 4: "MIN"}


def algorithm(name: str):
    """Registers a task's algorithm: a function of (runner, parties, params) that gives a frame, or one by party."""

    def add(f: Callable) -> Callable:
        ALGORITHMS[name] = f
        return f

    return add


def plugin(model: str, role: str):
    """Registers a class for a party's role in a model; it is made with (role, frame, params) and its run() gives a frame."""

    def add(cls: type) -> type:
        PLUGINS[model, role] = cls
        return cls

    return add


def function(name: str):
    """Registers a callable of (party, frame, params) that tasks may name; code in a task's text is never run."""

    def add(f: Callable) -> Callable:
        FUNCTIONS[name] = f
        return f

    return add


def in_order(parties) -> list[str]:
    """Names of parties, numbers in them by value: P2 before P10."""
    return sorted(parties, key=lambda p: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", p) if x])


@algorithm("python")
def _python(runner, parties, p):
    f = FUNCTIONS.get(p["function"])
    if f is None:
        raise ValueError(f"no such function: {p['function']}")
    return {party: f(party, df, p.get("args", {})) for party, df in parties.items()}


@algorithm("model")
def _plugin(runner, parties, p):
    roles = {party: p.get("roles", {}).get(party, party) for party in parties}
    unknown = [r for r in roles.values() if (p["model"], r) not in PLUGINS]
    if unknown:
        raise ValueError(f"{p['model']} has no role {', '.join(unknown)}")
    return {party: PLUGINS[p["model"], roles[party]](roles[party], df, p.get("options", {})).run() for party, df in parties.items()}


@algorithm("psi")
def _psi(runner, parties, p):
    client, server = parties[p.get("client", "CLIENT")], parties[p.get("server", "SERVER")]
    f = {"intersection": psi.intersection, "difference": psi.difference, "cardinality": psi.cardinality}[p.get("type", "intersection")]
    return f(client, server, p["keys"], p.get("server_keys"), protocol=p.get("protocol", 0), unique=p.get("unique", False))


@algorithm("pir")
def _pir(runner, parties, p):
    server = parties[p.get("server", "SERVER")]
    asked = lookup.query_frame(runner.spark, [tuple(k) if isinstance(k, list) else k for k in p["query"]]) if "query" in p else parties["CLIENT"].select(*p["query_columns"])
    return lookup.keyword_lookup(asked, server, p.get("keys"), p.get("labels"))


@algorithm("data_align")
def _align(runner, parties, p):
    """With new_dataset the aligned rows are written and registered under that id."""
    out = lookup.align(parties["TABLE"], p["keys"], parties["RESULT"], p["result_keys"], p["position"])
    return runner.kept(out, p["new_dataset"]) if p.get("new_dataset") else out


def plain(document):
    """A task's document without the wrapping of its values as {type, value}."""
    if isinstance(document, str):
        document = json.loads(document)
    while isinstance(document, dict) and "value" in document and set(document) <= {"type", "value"}:
        document = json.loads(document["value"]) if isinstance(document["value"], str) and document["value"].lstrip().startswith("{") else document["value"]
    return document


def statistics_document(p: dict) -> tuple[str, dict[str, list[str]], dict[str, dict]]:
    """Statistic, checked columns by dataset and what is said of each dataset (columns, newDataSetId, outputFilePath)."""
    detail, about = plain(p["TaskDetail"]), plain(p["ColumnInfo"])
    kind = STATISTICS.get(int(detail["type"]))
    if kind is None:
        raise ValueError(f"no such statistic: {detail['type']}")
    checked = {f["resourceId"]: list(f.get("checked", [])) for f in detail["features"]}
    for dataset, columns in checked.items():
        codes = about[dataset]["columns"]
        bad = [c for c in columns if Code(int(codes[c])) not in NUMERIC_CODES]
        if bad:
            raise TypeError(f"{', '.join(bad)} of {dataset} are not numbers")
    return kind, checked, about


@algorithm("mpc_statistics")
def _joint(runner, parties, p):
    """Plain parameters (type, columns), or TaskDetail and ColumnInfo: then the result, one row, is written and registered for each dataset that says so."""
    if "TaskDetail" not in p:
        return stats.joint(stats.union(parties), p["type"], p["columns"])
    kind, checked, about = statistics_document(p)
    columns = sorted(next(iter(checked.values())))
    if any(sorted(c) != columns for c in checked.values()):
        raise ValueError("the parties' checked columns differ")
    if not columns:
        return runner.spark.createDataFrame([], "nothing string").drop("nothing")
    frames = {d: runner.catalog.read(d).select([F.col(c).cast(CODE_TYPES[Code(int(about[d]["columns"][c]))]) for c in columns]) for d in checked}
    out = stats.joint(stats.union(frames), kind, columns)
    for d in checked:
        if about[d].get("newDataSetId"):
            runner.kept(out, about[d]["newDataSetId"], about[d].get("outputFilePath"))
    return out


@algorithm("arithmetic")
def _arithmetic(runner, parties, p):
    if "compare" in p:
        low, high = in_order(parties)
        return expression.compare(parties[low], parties[high], p["id"], *p["compare"])
    return expression.evaluate(p["expression"], list(parties.values()), p["id"], accuracy=p.get("accuracy"))


@algorithm("missing_values")
def _missing(runner, parties, p):
    """With new_datasets (party: id) each party's table is written and registered."""
    out = clean.impute_parties(parties, p["columns"], p.get("replace", "MAX"), p.get("places"))
    return {party: runner.kept(df, p["new_datasets"][party]) if party in p.get("new_datasets", {}) else df for party, df in out.items()}


@algorithm("abnormal")
def _abnormal(runner, parties, p):
    """Each party's abnormal values are repaired; with new_datasets (party: id) the tables are written and registered."""
    out = {party: clean.abnormal_table(df, p["columns"]) for party, df in parties.items()}
    return {party: runner.kept(df, p["new_datasets"][party]) if party in p.get("new_datasets", {}) else df for party, df in out.items()}


@algorithm("stats")
def _stats(runner, parties, p):
    return stats.StatsPipeline(p["stats"], p.get("mode", "H")).run(parties, p.get("columns"), p.get("id"), p.get("path"))


@algorithm("preprocess")
def _preprocess(runner, parties, p):
    df = stats.union(parties)
    pipe = PreprocessPipeline([(s.pop("module"), s) for s in map(dict, p["steps"])], p.get("label"), p.get("id"))
    out = pipe.fit_transform(df.drop(stats.PARTY) if not p.get("keep_party") else df)
    if p.get("model_path"):
        pipe.save(p["model_path"])
    return out


@algorithm("linear_regression")
def _linear(runner, parties, p):
    return _model(parties, p, "linear")


@algorithm("logistic_regression")
def _logistic(runner, parties, p):
    return _model(parties, p, p.get("sigmoid", "logistic"))


def _model(parties, p, kind):
    if p.get("vertical"):
        df = expression.joined(list(parties.values()), p["id"])
        m = linear.fit(df, p["features"], p["label"], kind, **p.get("options", {}))
    else:
        df = stats.union(parties)
        f = linear.fedavg if p.get("fedavg") else linear.fit
        m = f(df, p["features"], p["label"], kind, **p.get("options", {}))
    return m.predict(df.drop(stats.PARTY))


@algorithm("mpc_logistic")
def _mpc_logistic(runner, parties, p):
    """Logistic regression with the piecewise sigmoid; BatchSize and NumIters as a share and a number of steps."""
    return _mpc_model(parties, p, "piecewise")


@algorithm("mpc_linear")
def _mpc_linear(runner, parties, p):
    return _mpc_model(parties, p, "linear")


def _mpc_model(parties, p, kind):
    df = stats.union(parties)
    batch = min(1.0, int(p["BatchSize"]) / max(1, df.count())) if "BatchSize" in p else 1.0
    m = linear.fit(df, p["features"], p["label"], kind, epochs=int(p.get("NumIters", 50)), batch=batch, **p.get("options", {}))
    return m.predict(df.drop(stats.PARTY))


#: Names by which such tasks are also known.
ALGORITHMS |= {"AbnormalProcessTask": _missing, "mpc_lr": _mpc_logistic}


@algorithm("mlp")
def _mlp(runner, parties, p):
    df = stats.union(parties)
    return mlp.fit_mlp(df, p["features"], p["label"], p["hidden"], **p.get("options", {})).predict(df.drop(stats.PARTY))


@algorithm("xgboost")
def _trees(runner, parties, p):
    df = expression.joined(list(parties.values()), p["id"])
    return boosting.train(df, p["features"], p["label"], **p.get("options", {})).predict(df)


class Runner:
    """Runs tasks over a catalog. Each task has a job group, so that it can be stopped; an id runs once."""

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self.status, self.results = spark, catalog, {}, {}
        self.threads, self.errors = {}, {}

    def submit(self, task: str | dict) -> str:
        """Runs a task to its end and gives its id. Fields: algorithm, parties {party: dataset or {dataset, columns}}, params, reveal_to, output {party: path}."""
        t = json.loads(task) if isinstance(task, str) else task
        job = t.get("job_id") or uuid.uuid4().hex
        if job in self.status:
            return job
        self.check(t)
        self.status[job] = Status.RUNNING
        return self.execute(job, t)

    def check(self, t: dict) -> None:
        if t.get("algorithm") not in ALGORITHMS:
            raise ValueError(f"Unsupported algorithm: {t.get('algorithm')}")
        allowed = KINDS[TaskType(t["task_type"])] if "task_type" in t else None
        if allowed is not None and t["algorithm"] not in allowed:
            raise ValueError(f"{t['algorithm']} is no algorithm of a {t['task_type']}")

    def start(self, task: str | dict) -> str:
        """As submit, but in a thread of its own: gives the id at once, so that the task can be watched and killed."""
        t = json.loads(task) if isinstance(task, str) else dict(task)
        job = t["job_id"] = t.get("job_id") or uuid.uuid4().hex
        if job in self.status:
            return job
        self.check(t)
        self.status[job] = Status.RUNNING

        def run() -> None:
            try:
                self.execute(job, t)
            except Exception as e:  # what went wrong is kept, the status says that something did
                self.errors[job] = e

        self.threads[job] = InheritableThread(target=run, daemon=True)
        self.threads[job].start()
        return job

    def wait(self, job: str, seconds: float | None = None) -> Status:
        if job in self.threads:
            self.threads[job].join(seconds)
        return self.fetch_status(job)

    def execute(self, job: str, t: dict) -> str:
        self.spark.sparkContext.setJobGroup(job, t["algorithm"], True)
        try:
            parties = {}
            for party, d in t["parties"].items():
                d = d if isinstance(d, dict) else {"dataset": d}
                parties[party] = self.catalog.read(d["dataset"], d.get("columns"), d.get("as", party))
            result = ALGORITHMS[t["algorithm"]](self, parties, t.get("params", {}))
            if self.status[job] is not Status.RUNNING:
                return job  # killed meanwhile
            self.results[job] = (result, t.get("reveal_to"))
            for party, path in t.get("output", {}).items():
                self.write(self.result(job, party), path)
            self.status[job] = Status.SUCCESS if self.status[job] is Status.RUNNING else self.status[job]
        except Exception:
            self.status[job] = Status.FAIL
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return job

    def result(self, job: str, party: str):
        """What a party may see of a result."""
        result, reveal = self.results[job]
        if reveal is not None and party not in reveal:
            raise PermissionError(f"the result is not revealed to {party}")
        return result[party] if isinstance(result, dict) and party in result else result

    def write(self, result, path: str) -> None:
        if isinstance(result, DataFrame):
            result.select([F.col(c).cast("string").alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in result.dtypes]).write.mode("overwrite").csv(path, header=True)
        else:
            with open(path, "w") as f:
                json.dump(result, f, default=str)

    def kept(self, df: DataFrame, dataset_id: str, path: str | None = None) -> DataFrame:
        """Writes a frame, registers it as a dataset and gives what was written."""
        path = path or f"{scratch(self.spark, 'dataset')}/{re.sub(r'[^A-Za-z0-9_.-]', '_', dataset_id)}"
        tables.write_csv(df, path) if path.endswith(".csv") else df.write.mode("overwrite").parquet(path)
        self.catalog.register(Dataset(dataset_id, "csv" if path.endswith(".csv") else "parquet", path))
        return self.catalog.read(dataset_id)

    def update_status(self, job: str, status: Status | str) -> None:
        self.status[job] = Status(status)

    def fetch_status(self, job: str) -> Status:
        return self.status.get(job, Status.NONEXIST)

    def kill(self, job: str) -> None:
        """Stops what a running task (see start) has running on Spark, and marks it."""
        self.spark.sparkContext.cancelJobGroup(job)
        if self.status.get(job) is Status.RUNNING:
            self.status[job] = Status.FAIL
