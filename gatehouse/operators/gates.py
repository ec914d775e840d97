"""Extraction gates: defect signals of HTML, OCR and JSON extraction, combined into a quality.

quality = product over signals of 1 - clamp(max(0, weight) * clamp(signal)), in signal order; a document passes at
`threshold` or more, and a flag is raised for each signal whose weighted value is 0.5 or more.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.functions import counts
from gatehouse.functions.text import clamp, count, share, split

FLAG_AT = 0.5


@dataclass(frozen=True)
class Gate:
    """A gate's parameters: weights by signal, in order, and a threshold. signals: columns by name, over split() of the text, or over the
    struct _n where `counts` makes one of the text, or `joined` adds it to the rows."""

    name: str
    weights: Mapping[str, float]
    signals: Callable[[Gate], dict[str, Column]]
    threshold: float = 0.5
    reads: str = "text"
    schema: Mapping[str, str] = field(default_factory=dict)
    counts: Callable[[Column], Column] | None = None
    joined: Callable[[DataFrame], DataFrame] | None = None

    def params(self) -> dict[str, float]:
        return {**self.weights, "threshold": self.threshold}

    def bounds(self) -> dict[str, tuple[float, float]]:
        return {**dict.fromkeys(self.weights, (0.0, 5.0)), "threshold": (0.05, 0.95)}

    def with_params(self, values: Mapping[str, float]) -> Gate:
        """A gate with other parameters: weights at least 0, the threshold within 0.05 .. 0.95; unknown names are ignored."""
        weights = {k: max(0.0, float(values.get(k, w))) for k, w in self.weights.items()}
        return replace(self, weights=weights, threshold=min(0.95, max(0.05, float(values.get("threshold", self.threshold)))))

    def prepare(self, df: DataFrame) -> DataFrame:
        """df with the gate's signals as columns s_<name>."""
        cols = {f"s_{k}": clamp(v) for k, v in self.signals(self).items()}
        if self.name == "json":
            rows = json_columns(df)
            rows = _held(rows, self.schema) if self.schema else rows
            return rows.withColumns(cols).drop("_raw", "_v", "_rest", "_fold", "_held")
        if self.joined:
            return self.joined(df).withColumns(cols).drop("_n")
        if self.counts:
            return df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_n", self.counts(F.col("text"))).withColumns(cols).drop("_n")
        return split(df).withColumns(cols).drop("tokens", "words", "lines")

    def channels(self) -> dict[str, Column]:
        return {k: clamp(F.lit(max(0.0, float(w))) * F.col(f"s_{k}")) for k, w in self.weights.items()}

    def evaluate(self, df: DataFrame) -> DataFrame:
        """df with signals s_<name>, gate_quality, gate_passed and gate_flags."""
        made = self.channels()
        quality = reduce(lambda a, b: a * b, [F.lit(1.0) - c for c in made.values()])
        flags = F.array_compact(F.array(*[F.when(c >= FLAG_AT, F.lit(k)) for k, c in made.items()]))
        return self.prepare(df).withColumns({"gate_quality": quality, "gate_flags": flags}).withColumn("gate_passed", F.col("gate_quality") >= F.lit(self.threshold))


def combine(qualities: list[Column]) -> Column:
    """The weakest of several gates; 1 of none."""
    return F.coalesce(F.least(*qualities), F.lit(1.0)) if len(qualities) > 1 else F.coalesce(*qualities, F.lit(1.0))


def _html(_: Gate) -> dict[str, Column]:
    n, chars = F.col("_n"), F.greatest(F.col("_n")["chars"], F.lit(1))
    return {
        "markup_leak": n["tag_chars"] / chars * 6 + n["marks"] / n["lines"],
        "boilerplate_leak": n["phrases"] / n["lines"] * 2.0,
        "link_density": n["links"] / n["lines"],
        "nonprose_lines": share(F.greatest(F.lit(0), n["menu"] - 1), n["full"]) * 1.2,  # one line like a menu is allowed
        "stopword_deficit": F.lit(1.0) - F.least(F.lit(1.0), share(n["stop"], n["words"]) / 0.12),
    }


def _ocr(_: Gate) -> dict[str, Column]:
    n, tokens, chars = F.col("_n"), F.greatest(F.col("_n")["tokens"], F.lit(1)), F.greatest(F.length("text"), F.lit(1))
    return {
        "garbage_rate": n["garbage"] / tokens * 2.5,
        "confusion_rate": n["confused"] / tokens * 3.0,
        "broken_word": n["hyphens"] / n["lines"] * 2.0 + n["tiny"] / tokens * 3.0,
        "mojibake": n["foreign"] / tokens * 5.0 + count(F.col("text"), "�") / tokens * 8.0,
        "line_noise": n["noisy"] / tokens * 5.0 + n["glyphs"] / chars * 30.0,
    }


# --- JSON ---

_STRINGS = r'(?s)"(\\.|[^"\\])*+"'


def json_columns(df: DataFrame, raw: Column | None = None) -> DataFrame:
    """df with the raw record, its parsed form, what stands outside its strings, and a fold over the brackets in that."""
    if raw is None:
        raw = F.coalesce(F.col("raw") if "raw" in df.columns else F.lit(None).cast("string"), F.col("text"), F.lit(""))
    df = df.withColumn("_raw", raw).withColumns({"_v": F.try_parse_json("_raw"), "_rest": F.regexp_replace("_raw", _STRINGS, "")})
    brackets = F.regexp_extract_all("_rest", F.lit(r"[\[\]{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit(0).alias("n"), F.lit(0).alias("closed"))

    def step(s, b):
        depth = s["depth"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        n = s["n"] + 1
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"), n.alias("n"), F.when((s["closed"] == 0) & (depth == 0), n).otherwise(s["closed"]).alias("closed"))

    pair = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit(2).alias("n"), F.lit(2).alias("closed"))
    only = F.regexp_replace("_rest", r"[^\[\]{}]+", "")  # a flat record's need no walk, which is interpreted
    return df.withColumn("_fold", F.when(only == "", zero).when(only.isin("{}", "[]"), pair).otherwise(F.aggregate(brackets, zero, step)))


def balanced() -> Column:
    """Brackets outside strings never close too early and all close, and no string stays open."""
    f = F.col("_fold")
    return (f["low"] >= 0) & (f["depth"] == 0) & ~F.contains(F.col("_rest"), F.lit('"'))


def parses() -> Column:
    """A single JSON value: the parser also accepts what follows a first value, so the first bracket must close at the last one."""
    f = F.col("_fold")
    single = (f["n"] == 0) | ((f["closed"] == f["n"]) & F.col("_rest").rlike(r"[}\]]\s*$"))
    return F.col("_v").isNotNull() & single


def type_name(kind: Column) -> Column:
    """string, bool, int, float, list, dict or null of a variant's schema."""
    return (
        F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int")
        .when(kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").otherwise("other")
    )


def _floor(n: Column, of: int, least: float) -> Column:
    return F.when(n == 0, 0.0).otherwise(clamp(F.greatest(F.lit(least), n / of)))


#: SQL for the value that a record has under a key, which may be a column.
_VALUE = "try_variant_get(_v, concat('$[''', {}, ''']'), 'variant')"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Bits of each of the counts of keys that _held packs.
_BITS = 20


def _held(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Rows of json_columns() with _held: how many keys of a schema a record lacks, holds with another kind, and holds empty. Keys are columns of generated code, each judged once."""
    df = df.withColumn("_keys", F.when(parses() & F.schema_of_variant("_v").startswith("OBJECT"), F.json_object_keys("_raw")))
    value = {k: _VALUE.format(_quoted(k)) for k in schema}
    df = df.withColumns({f"_t{i}": type_name(F.expr(f"schema_of_variant({v})")) for i, v in enumerate(value.values())})
    held = F.lit(0).cast("long")
    for i, (key, kind) in enumerate(schema.items()):
        there, got = F.array_contains("_keys", key), F.col(f"_t{i}")
        wrong = there & ~got.isin("null") & (got != kind) & ~(F.lit(kind == "float") & (got == "int"))
        empty = there & ((got == "null") | F.expr(f"to_json({value[key]})").isin('""', "[]", "{}"))
        for k, test in enumerate((~there, wrong, empty)):
            held = held + F.when(test, F.lit(1 << _BITS * k).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.withColumn("_held", held).drop("_keys", *[f"_t{i}" for i in range(len(schema))])


def _json(gate: Gate) -> dict[str, Column]:
    ok, whole = parses(), balanced()
    missing, wrong, empty = (F.shiftright("_held", _BITS * k).bitwiseAND((1 << _BITS) - 1) if gate.schema else F.lit(0) for k in range(3))
    n = max(1, len(gate.schema))
    return {
        "parse_fail": F.when(ok, 0.0).otherwise(1.0),
        "truncated": F.when(whole, 0.0).otherwise(1.0),
        "schema_missing": _floor(missing, n, 0.6),
        "type_mismatch": _floor(wrong, n, 0.6),
        "empty_value": _floor(empty, n, 0.5),
    }


def infer_schema(records: DataFrame, raw: str = "raw", order: str = "doc_id", required: float = 0.8) -> DataFrame:
    """key, kind: keys in at least `required` of the records that parse to objects, with their modal non-null type (the first seen wins ties)."""
    rows = json_columns(records.select(F.col(order).alias("_o"), raw), F.coalesce(F.col(raw), F.lit(""))).where(parses() & F.schema_of_variant("_v").startswith("OBJECT"))
    keys = rows.select("_o", "_v", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.json_object_keys("_raw"), F.array().cast("array<string>")))).alias("key"))  # null: the record itself
    typed = keys.select("_o", "key", F.when(F.col("key").isNotNull(), type_name(F.expr(f"schema_of_variant({_VALUE.format('key')})"))).alias("kind"))
    by = typed.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first"))
    best = cut(by.groupBy("key").agg(F.sum("n").alias("n_records"), F.min_by("kind", F.when(F.col("kind") != "null", F.struct((-F.col("n")).alias("a"), F.col("first").alias("b")))).alias("kind")))
    n = best.where("key IS NULL").select(F.col("n_records").alias("records"))
    return best.where("key IS NOT NULL").crossJoin(F.broadcast(n)).where(F.col("n_records") >= F.lit(required) * F.greatest("records", F.lit(1))).select("key", F.coalesce("kind", F.lit("string")).alias("kind"), "n_records")


HTML = Gate("html", {"markup_leak": 2.0, "boilerplate_leak": 1.6, "link_density": 1.6, "nonprose_lines": 1.4, "stopword_deficit": 0.8}, _html, counts=counts.html)
OCR = Gate("ocr", {"garbage_rate": 1.5, "confusion_rate": 1.1, "broken_word": 1.0, "mojibake": 1.4, "line_noise": 0.8}, _ocr, counts=counts.ocr)
JSON = Gate("json", {"parse_fail": 2.0, "truncated": 1.5, "schema_missing": 1.4, "type_mismatch": 1.2, "empty_value": 1.6}, _json, reads="raw")
GATES: dict[str, Gate] = {g.name: g for g in (HTML, OCR, JSON)}


def register(gate: Gate) -> None:
    """Makes a gate known under its name, for routing by modality."""
    GATES[gate.name] = gate
