"""Jobs from a configuration: nested options, or lines of ``path.to.option = value``."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from foldmill.functions.tokens import LINES
from foldmill.operators.apps import count_spec, field_count_spec
from foldmill.plans.job import Job
from foldmill.plans.spec import lookup
from foldmill.sources import readers

#: Options that a configuration may hold; all of them have a default.
DEFAULTS = {
    "input.path": None,
    "input.mode": "chunk",
    "input.delimiter": LINES,
    "input.delimiter_second": None,
    "input.query": None,
    "input.query_file": None,
    "input.query_kind": "word",
    "map.tasks": 0,
    "reduce.tasks": 0,
    "aggregate.combine": True,
    "aggregate.name": None,
    "aggregate.grams": 1,
    "aggregate.strategy": "bucket",
    "aggregate.rounds": 0,
    "output.path": None,
    "output.kind": "parquet",
}


@dataclass
class Configured:
    job: Job
    output: str | None
    kind: str


def flat(options: dict, at: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for name, value in options.items():
        out |= flat(value, f"{at}{name}.") if isinstance(value, dict) else {f"{at}{name}": value}
    return out


def parse(text: str) -> dict[str, str]:
    """Options of a text: one a line, ``#`` before remarks, escapes such as \\n in quoted values."""
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        name, sign, value = (part.strip() for part in body.partition("="))
        if not sign or not name:
            raise ValueError(f"line {number} is no option: {line!r}")
        out[name] = value[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape") if len(value) > 1 and value[0] == value[-1] == '"' else value
    return out


def switch(value: object) -> bool:
    if str(value).lower() not in ("true", "false", "1", "0", "yes", "no"):
        raise ValueError(f"{value!r} is neither true nor false")
    return str(value).lower() in ("true", "1", "yes")


def configured(options: dict | str | Path, spark: SparkSession | None = None) -> Configured:
    """The job of nested options, of a configuration's text, or of a local file of it.

    A named aggregate is looked up; without a name the job counts: the n-grams of the
    input's tokens, or with a second delimiter the first fields of its records. Records
    are crossed with the words of ``input.query``, or with the list in ``input.query_file``
    (words, or with ``input.query_kind`` file the files that it names); these need ``spark``.
    """
    if isinstance(options, Path):
        options = options.read_text()
    given = parse(options) if isinstance(options, str) else flat(options)
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"no options {', '.join(sorted(unknown))}")
    o = DEFAULTS | given
    if o["aggregate.name"]:
        spec = lookup(str(o["aggregate.name"]))
    elif o["input.delimiter_second"]:
        spec = field_count_spec("value", str(o["input.delimiter"]), str(o["input.delimiter_second"]))
    else:
        spec = count_spec(int(o["aggregate.grams"]), "value", str(o["input.delimiter"]))
    asked = None
    if o["input.query"] or o["input.query_file"]:
        if spark is None:
            raise ValueError("queries need a session")
        if o["input.query_file"]:
            asked = readers.queries(spark, str(o["input.query_file"]), str(o["input.query_kind"]))
        else:
            words = o["input.query"] if isinstance(o["input.query"], list) else str(o["input.query"]).split()
            asked = spark.createDataFrame([(w,) for w in words], "query string")
    tasks = {"mappers": int(o["map.tasks"]), "reducers": int(o["reduce.tasks"]), "combine": switch(o["aggregate.combine"])}
    job = Job(spec, mode=str(o["input.mode"]), path=o["input.path"], strategy=str(o["aggregate.strategy"]), rounds=int(o["aggregate.rounds"]), queries=asked, **tasks)
    return Configured(job, o["output.path"], str(o["output.kind"]))
