"""The registered queries: each applies an operator to a whole table of the given folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut, ensure_checkpoint_dir
from gatehouse.functions import lexicon as X
from gatehouse.functions import order, stats
from gatehouse.functions.text import features, gzip_ratio
from gatehouse.operators import baselines, climb, gates, metrics, mutate, outliers, report, verify
from gatehouse.operators.cascade import Config, curate, provenance, with_score
from gatehouse.operators.window import Window
from gatehouse.plans.oracles import ORACLES
from gatehouse.sources import adapters as src
from gatehouse.sources.adapters import draw
from gatehouse.sources.ledger import Ledger
from gatehouse.streaming import routine, spc

#: Features whose values are exact ratios of counts.
CHARACTER = ("char_length", "alpha_fraction", "digit_fraction", "punct_fraction", "uppercase_fraction", "non_ascii_fraction")
LINE = ("dup_line_fraction", "bullet_line_fraction", "ellipsis_line_fraction", "short_line_fraction", "mean_line_length")
LEXICAL = ("token_length", "mean_word_length", "type_token_ratio", "bigram_repetition", "stopword_fraction", "symbol_word_ratio", "mojibake_fraction")
#: All features but the compression ratio, which SQL has no function for.
COHORT = tuple(n for n in X.FEATURES if n != "gzip_ratio")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _profile(names):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features(src.documents(spark, sf_dir), names).select("doc_id", *names), *names)

    return run


def profile_gzip(spark, sf_dir):
    return src.documents(spark, sf_dir).select("doc_id", F.round(gzip_ratio("text"), 6).alias("gzip_ratio"))


def governance_score(spark, sf_dir):
    return rounded(with_score(src.documents(spark, sf_dir)).select("doc_id", "governance_score"), "governance_score")


def _decided(spark, sf_dir, mode="heuristic"):
    return curate(src.documents(spark, sf_dir), mode)


def curate_heuristic(spark, sf_dir):
    return rounded(_decided(spark, sf_dir).select("doc_id", "label", "label_name", "score", "stage"), "score")


def curate_judge_stub(spark, sf_dir):
    return rounded(_decided(spark, sf_dir, "cascade").select("doc_id", "label", "score", "stage", "escalated"), "score")


def curate_budget(spark, sf_dir):
    """A judge's budget of a fifth of the documents, spent on the middle of the scores."""
    decided = curate(src.documents(spark, sf_dir), "budget", share=0.2)
    return decided.select("doc_id", "label", "stage", "escalated")


def curate_pages(spark, sf_dir):
    """The HTML gate ahead of the score, on pages."""
    return rounded(curate(src.pages(spark, sf_dir)).select("doc_id", "label", "score", "stage", F.array_join("reasons", ",").alias("reasons"), "gate_quality", "extractor"), "score", "gate_quality")


def report_summary(spark, sf_dir):
    return report.summary(_decided(spark, sf_dir, "cascade"))


def report_by_source(spark, sf_dir):
    return report.by(_decided(spark, sf_dir), "source")


def responsibility(spark, sf_dir):
    return report.by(_decided(spark, sf_dir, "cascade"), "stage")


def report_counts(spark, sf_dir):
    return report.counts(_decided(spark, sf_dir))


def risk_grades(spark, sf_dir):
    """Risk grades of one less the governance score."""
    rows = with_score(src.documents(spark, sf_dir))
    return rows.groupBy(report.risk_grade(F.round(1 - F.col("governance_score"), 9)).alias("risk")).agg(F.count(F.lit(1)).alias("n_docs"))


def cohort_stats(spark, sf_dir):
    """Mean, deviation, median, MAD and quartile of text length by source."""
    rows = src.documents(spark, sf_dir).select("source", F.length("text").cast("double").alias("x"))
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), stats.mean(F.col("x")).alias("mean"), stats.std(F.col("x")).alias("std"))
    robust = outliers.fit(rows, ("x",)).where("not pooled").select("source", "med", "mad")
    quartile = order.quantiles(order.tallied(rows, ["source"], F.col("x")), ["source"], q1=0.25).select("source", "q1")
    by = by.join(robust, "source", "left").join(quartile, "source", "left").fillna(0.0, ["med", "mad", "q1"])
    return rounded(by, "mean", "std", "med", "mad", "q1", places=4)


def cohort_median_mad(spark, sf_dir):
    fitted = outliers.fit(features(src.documents(spark, sf_dir), COHORT), COHORT)
    return rounded(fitted.select(F.when(F.col("pooled"), "*").otherwise(F.col("source")).alias("source"), "feature", "n", "med", "mad"), "med", "mad")


def cohort_outliers(spark, sf_dir):
    found = outliers.profile(features(src.documents(spark, sf_dir), COHORT), names=COHORT)
    return rounded(found.select("doc_id", "source", F.array_join("outlier_flags", ",").alias("flags"), "outlier_score", "is_outlier"), "outlier_score", places=4)


def outliers_reference(spark, sf_dir):
    """Conversations against the statistics of documents: a reference window that is fitted on one table and scores another."""
    docs = features(src.documents(spark, sf_dir), COHORT)
    fitted = outliers.fit(docs.withColumn("source", F.lit("window")), COHORT)
    found = outliers.score(features(src.conversations(spark, sf_dir), COHORT), fitted, names=COHORT)
    return rounded(found.select("doc_id", "source", F.array_join("outlier_flags", ",").alias("flags"), "outlier_score", "is_outlier"), "outlier_score", places=4)


def _folder(spark: SparkSession, stem: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{stem}-{uuid.uuid4().hex}"


def window_versions(spark, sf_dir):
    """The statistics of a reference window's three versions: documents are added in three days, and no day is read again."""
    docs = cut(features(src.documents(spark, sf_dir), COHORT).select("source", F.pmod(draw(0, F.col("doc_id"), "day"), F.lit(3)).alias("day"), *COHORT))
    window, rows = Window(spark, _folder(spark, "window"), COHORT), None
    for day in range(3):
        window.add(docs.where(F.col("day") == day), day)
        stats = window.stats(window.fit()).withColumn("version", F.lit(day + 1))
        rows = stats if rows is None else rows.unionByName(stats)
    return rounded(rows.select("version", F.when(F.col("pooled"), "*").otherwise(F.col("source")).alias("source"), "feature", "n", "med", "mad"), "med", "mad")


def window_stream(spark, sf_dir):
    """Conversations as a stream against the last version of a window of documents. Their sources are unseen there, so the pooled statistics hold."""
    window = Window(spark, _folder(spark, "window"), COHORT)
    window.add(features(src.documents(spark, sf_dir), COHORT), 0)
    version, out = window.fit(), _folder(spark, "scored")
    at = f"{sf_dir}/conversation[s].parquet"  # a pattern may name one file, which a stream doesn't take otherwise
    turns = src.turns(spark.readStream.schema(src.table(spark, sf_dir, "conversations").schema).parquet(at))
    found = window.score(features(turns, COHORT), version)
    shown = rounded(found.select("doc_id", "source", F.array_join("outlier_flags", ",").alias("flags"), "outlier_score", "is_outlier"), "outlier_score", places=4)
    shown.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shown.schema).parquet(out)


def curate_with_outliers(spark, sf_dir):
    """Decisions beside the outlier flags of their profiles, counted by label."""
    docs = src.documents(spark, sf_dir)
    joined = report.with_outliers(curate(docs), outliers.profile(features(docs, COHORT), names=COHORT))
    return joined.groupBy("label_name", F.coalesce("is_outlier", F.lit(False)).alias("is_outlier")).agg(F.count(F.lit(1)).alias("n_docs"))


def series_ewma(spark, sf_dir):
    """Exponentially weighted mean of each stream's daily values, and a short digest of its name."""
    days = _daily(spark, sf_dir).groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "mean_value"))), lambda d: d["mean_value"]).alias("v"))
    return days.select("stream", stats.sha1_short(F.col("stream")).alias("digest"), F.round(stats.ewma(F.col("v"), 0.3), 6).alias("ewma"))


def gates_combined(spark, sf_dir):
    """The weakest of the HTML and the OCR gate for each page."""
    docs = src.pages(spark, sf_dir)
    a = gates.HTML.evaluate(docs).withColumnRenamed("gate_quality", "html_quality").select("doc_id", "text", "html_quality")
    both = gates.OCR.evaluate(a)
    return rounded(both.select("doc_id", gates.combine([F.col("html_quality"), F.col("gate_quality")]).alias("quality")), "quality")


def record_gate(spark, sf_dir):
    """Records with missing, retyped and empty values through the gate, against the schema inferred from all of them."""
    d = src.table(spark, sf_dir, "documents")
    n = F.pmod(draw(5, F.col("doc_id"), "field"), F.lit(6))
    parts = {"id": F.col("doc_id").cast("string"), "lang": F.concat(F.lit('"'), F.col("lang"), F.lit('"')), "source": F.concat(F.lit('"'), F.col("source"), F.lit('"')), "share": F.concat(F.pmod("doc_id", F.lit(97)).cast("string"), F.lit(".5"))}
    parts["lang"] = F.when(n == 1, '""').when(n == 2, "null").otherwise(parts["lang"])
    parts["id"] = F.when(n == 3, F.concat(F.lit('"'), parts["id"], F.lit('"'))).otherwise(parts["id"])
    parts["share"] = F.when(n == 4, F.lit("7")).otherwise(parts["share"])
    each = [F.when(~((n == 5) & F.lit(k == "source")), F.concat(F.lit(f'"{k}": '), v)) for k, v in parts.items()]
    raw = F.concat(F.lit("{"), F.concat_ws(", ", *each), F.lit("}"))
    records = src.as_documents(d, F.col("doc_id"), raw, F.col("source"), F.lit("json"), raw)
    schema = {r["key"]: r["kind"] for r in gates.infer_schema(records).collect()}  # keys of one record
    got = gates.Gate("json", gates.JSON.weights, gates.JSON.signals, reads="raw", schema=schema).evaluate(records)
    cols = [f"s_{k}" for k in gates.JSON.weights]
    return rounded(got.select("doc_id", *cols, "gate_quality", "gate_passed", F.array_join("gate_flags", ",").alias("flags")), *cols, "gate_quality")


def outliers_ksigma(spark, sf_dir):
    return outliers.k_sigma(features(src.documents(spark, sf_dir), COHORT), names=COHORT)


def html_gate_pages(spark, sf_dir):
    got = gates.HTML.evaluate(src.pages(spark, sf_dir))
    cols = [f"s_{k}" for k in gates.HTML.weights]
    return rounded(got.select("doc_id", *cols, "gate_quality", "gate_passed", F.array_join("gate_flags", ",").alias("flags")), *cols, "gate_quality")


def ocr_gate_documents(spark, sf_dir):
    got = gates.OCR.evaluate(src.documents(spark, sf_dir, "ocr"))
    cols = [f"s_{k}" for k in gates.OCR.weights]
    return rounded(got.select("doc_id", *cols, "gate_quality", "gate_passed", F.array_join("gate_flags", ",").alias("flags")), *cols, "gate_quality")


def json_infer_schema(spark, sf_dir):
    return gates.infer_schema(src.events(spark, sf_dir))


def _broken_events(spark, sf_dir):
    return mutate.corrupt(src.events(spark, sf_dir), "json", 3)


def json_gate_events(spark, sf_dir):
    """Damaged records through the gate, with the schema inferred from the whole ones."""
    schema = {r["key"]: r["kind"] for r in gates.infer_schema(src.events(spark, sf_dir)).collect()}  # keys of one record
    gate = gates.Gate("json", gates.JSON.weights, gates.JSON.signals, reads="raw", schema=schema)
    got = gate.evaluate(src.events(spark, sf_dir).unionByName(_broken_events(spark, sf_dir).select("doc_id", "text", "source", "modality", "raw")))
    return got.groupBy("gate_passed", F.array_join("gate_flags", ",").alias("flags"), F.round("gate_quality", 6).alias("gate_quality")).agg(F.count(F.lit(1)).alias("n"))


def json_balanced(spark, sf_dir):
    rows = gates.json_columns(_broken_events(spark, sf_dir))
    return rows.select("doc_id", "raw", gates.balanced().alias("balanced"), gates.parses().alias("parses"))


def provenance_ledger(spark, sf_dir):
    return provenance(_decided(spark, sf_dir), "2024-01-01T00:00:00Z")


def ledger_current(spark, sf_dir):
    """The latest of two decisions for each page: the first under default thresholds, the second under stricter ones."""
    docs = src.pages(spark, sf_dir)
    strict = Config(gates={"html": 0.8, "json": 0.5, "ocr": 0.5})
    ledger = Ledger(spark, _folder(spark, "ledger"))
    ledger.append(provenance(curate(docs), "day-0"), 0)
    ledger.supersede(provenance(curate(docs, config=strict), "day-1", strict), 1)
    ledger.append_summary({"pages": docs.count()}, 1)
    n = ledger.records().where("kind <> 'summary'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_records"))
    now = ledger.current().select("doc_id", "decision", "responsible_stage", "fetch_time", "supersedes").join(n, "doc_id")
    return now.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("supersedes", F.col("supersedes").cast("long"))


def ledger_versions(spark, sf_dir):
    """Decisions on pages as of each of two batches, the second of which decides half of them anew under stricter thresholds; the last is read from the compaction."""
    docs, strict = src.pages(spark, sf_dir), Config(gates={"html": 0.8, "json": 0.5, "ocr": 0.5})
    ledger = Ledger(spark, _folder(spark, "ledger"))
    ledger.append(provenance(curate(docs), "day-0"), 0)
    ledger.supersede(provenance(curate(docs.where(F.col("doc_id") % 2 == 0), config=strict), "day-1", strict), 1)
    ledger.compact()
    rows = ledger.current(0).withColumn("as_of", F.lit(0)).unionByName(ledger.current().withColumn("as_of", F.lit(1)))
    return rows.select("as_of", F.col("doc_id").cast("long").alias("doc_id"), "decision", "responsible_stage", "fetch_time")


def _predicted(spark, sf_dir):
    gold = src.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _decided(spark, sf_dir).join(gold, "doc_id")


def macro_f1_labels(spark, sf_dir):
    gold = F.when(F.col("quality") == 1, 2).otherwise(0)
    return _predicted(spark, sf_dir).agg(F.round(metrics.macro_f1(F.col("label"), gold), 6).alias("macro_f1"), F.round(metrics.agreement(F.col("label"), gold), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


def binary_prf_labels(spark, sf_dir):
    prf = metrics.binary_prf((F.col("label") > 0).cast("int"), F.col("quality"))
    return _predicted(spark, sf_dir).agg(*[F.round(v, 6).alias(k) for k, v in prf.items()])


def cascade_budget_curve(spark, sf_dir):
    """The judge of this curve is the label itself."""
    gold = F.when(F.col("quality") == 1, 2).otherwise(0)
    rows = with_score(src.documents(spark, sf_dir)).join(src.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.round("governance_score", 9).alias("score"), gold.alias("judge_label"), gold.alias("gold"))
    return rounded(metrics.budget_curve(rows), "macro_f1", "agreement")


def _corrupted(kind, op, which="heldout"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = src.events(spark, sf_dir) if kind == "json" else src.documents(spark, sf_dir)
        target = "raw" if kind == "json" else "text"
        return mutate.corrupt(docs, kind, 1, which, (op,)).select("doc_id", F.length(target).alias("n_chars"), F.md5(F.col(target).cast("binary")).alias("digest"))

    return run


def _matrix(spark, sf_dir):
    return verify.signals(gates.HTML, src.documents(spark, sf_dir), "html", range(5), ("heldout", "train"))


def mutation_eval(spark, sf_dir):
    return rounded(verify.score(_matrix(spark, sf_dir), [gates.HTML]), "precision", "recall", "f1", "fpr")


def floor_upper(spark, sf_dir):
    return rounded(verify.floor_and_upper(_matrix(spark, sf_dir), gates.HTML), "f1", "recall", "fpr")


def guard_fpr(spark, sf_dir):
    return rounded(verify.guard_fpr(gates.HTML, src.pages(spark, sf_dir)), "guard_fpr")


def _grid():
    return [gates.HTML.with_params({"threshold": t, "markup_leak": w}) for t in (0.3, 0.5, 0.7) for w in (1.0, 2.0)]


def candidate_grid_objective(spark, sf_dir):
    return rounded(verify.objective(verify.score(_matrix(spark, sf_dir), _grid())), "f1", "recall", "fpr", "objective")


def accept_rule(spark, sf_dir):
    return rounded(verify.accept_rule(verify.score(_matrix(spark, sf_dir), _grid()), 0, 3), "delta_f1", "lower_bound", "delta_fpr")


def hillclimb_trajectory(spark, sf_dir):
    """The three regimes from halved weights: thirty iterations of ten candidates over all operators and five seeds. A third of the documents is climbed on, a third accepts, a third guards."""
    docs = src.documents(spark, sf_dir, "html")
    sets = [docs.where(F.pmod(draw(0, F.col("doc_id"), "part"), F.lit(3)) == k) for k in range(3)]
    start = gates.HTML.with_params({k: w / 2 for k, w in gates.HTML.weights.items()})
    config = climb.ClimbConfig(iterations=30, population=10, step=0.12)
    seen = climb.measured(start, sets[0], "html", sets[1], guard_docs=sets[2])
    done = [step for regime in ("naive_recall", "naive_f1", "verified") for step in climb.hillclimb(start, sets[0], "html", regime, config, sets[1], guard_docs=sets[2], seen_before=seen).trajectory]
    return spark.createDataFrame(done, "regime string, iter int, recall_train double, f1_heldout double, guard_fpr double")


def _generated(spark, sf_dir):
    """A generated clean document for each given one, so that it grows with them."""
    return src.clean_corpus(spark, src.table(spark, sf_dir, "documents").count())


def clean_corpus(spark, sf_dir):
    return _generated(spark, sf_dir)


def benchmark_export(spark, sf_dir):
    """Clean, train-slice and held-out-slice rows of the generated corpus, with operator and slice."""
    docs = _generated(spark, sf_dir)
    rows = docs.select("*", F.explode(F.array(F.lit("clean"), F.lit("train"), F.lit("heldout"))).alias("slice"))  # the corpus is made once
    return mutate.corrupt_by_modality(rows, 7, F.col("slice"), F.col("slice") != "clean").select(*docs.columns, "operator", "slice", F.lit(7).alias("seed"))


def naive_text(spark, sf_dir):
    return src.pages(spark, sf_dir).select("doc_id", "source", "text")


def simple_reextract(spark, sf_dir):
    return src.pages(spark, sf_dir).select("doc_id", routine.simple_reextract(F.col("raw")).alias("text"))


def _daily(spark, sf_dir):
    return spc.daily(src.table(spark, sf_dir, "events")).withColumn("day", F.datediff("date", F.lit("2024-01-01")))


def daily_streams(spark, sf_dir):
    return rounded(_daily(spark, sf_dir).select("stream", "day", "throughput", "mean_value"), "mean_value")


def _chart(value, watch="two_sided"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = spc.monitor(_daily(spark, sf_dir).select("stream", "day", F.col(value).alias("value")), 10, spc.Chart(watch=watch))
        return rounded(got, "value", "ewma", "cusum_pos", "cusum_neg")

    return run


def spc_events(spark, sf_dir):
    """Every event as a point of its type's chart, watched upwards. What is rounded is moved off decimal ties first."""
    e = src.table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("day"), "value")
    got = spc.scan(e, 100, spc.Chart(watch="up"))
    return got.withColumns({c: F.round(F.col(c) + 2.718e-7, 6) for c in ("ewma", "cusum_pos", "cusum_neg")})


def routine_ticks(spark, sf_dir):
    """Thirteen days of pages, all of them with leaked markup from the eleventh on, and remediation after the alarm."""
    docs = src.pages(spark, sf_dir)
    loop = routine.Routine(warmup=10, remediator=lambda d: d.withColumn("text", routine.simple_reextract(F.col("text"))))
    harness = routine.LocalHarness()
    for day in range(13):
        own = docs.where(F.pmod(draw(0, F.col("doc_id"), "day"), F.lit(13)) == day)
        loop.tick(harness, own if day < 10 else own.withColumn("text", mutate.script_style(F.col("text"), 0, F.col("doc_id"), "heldout")))
    rows = [(s["day"], s["ok"], s["throughput"], s["quality"], ",".join(s["alerts"]), ",".join(s["actions"])) for s in harness.summaries]
    return spark.createDataFrame(rows, "day int, ok boolean, throughput double, quality double, alerts string, actions string")


def routine_stream(spark, sf_dir):
    """The same thirteen days as files that a stream reads; charts, ledger and what is waited for are kept under its micro-batches."""
    docs = src.pages(spark, sf_dir).withColumn("day", F.pmod(draw(0, F.col("doc_id"), "day"), F.lit(13)).cast("int"))
    leaked = mutate.script_style(F.col("text"), 0, F.col("doc_id"), "heldout")
    path = _folder(spark, "days")
    docs.withColumn("text", F.when(F.col("day") < 10, F.col("text")).otherwise(leaked)).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in routine.STAGED.split(", ")]).write.parquet(path)
    loop = routine.DailyStream(Ledger(spark, _folder(spark, "ledger")), remediator=lambda d: d.withColumn("text", routine.simple_reextract(F.col("text"))), lag=0)
    loop.start(spark.readStream.schema(routine.STAGED).parquet(path), f"{path}-state").awaitTermination()
    days = loop.summaries()
    return days.select("day", "ok", "throughput", "quality", F.array_join("alerts", ",").alias("alerts"), F.array_join("actions", ",").alias("actions"))


def baseline_gopher(spark, sf_dir):
    got = baselines.GOPHER.evaluate(src.pages(spark, sf_dir))
    return rounded(got.select("doc_id", "s_stopword_deficit", "s_symbols", "gate_quality", "gate_passed"), "s_stopword_deficit", "s_symbols", "gate_quality")


def baseline_dict_oov(spark, sf_dir):
    """Documents against the words of the benchmark."""
    words = baselines.vocabulary(src.table(spark, sf_dir, "benchmark"))
    return rounded(baselines.oov(src.documents(spark, sf_dir), words), "oov_share", "s_oov")


def baseline_parse_only(spark, sf_dir):
    got = baselines.PARSE_ONLY.evaluate(_broken_events(spark, sf_dir))
    return got.select("doc_id", "gate_passed")


def baseline_gzip(spark, sf_dir):
    docs = src.documents(spark, sf_dir)
    return rounded(baselines.gzip_signal(docs, baselines.fit_gzip(docs)), "gzip_ratio", "s_gzip")


QUERIES = {
    "profile_char_classes": _profile(CHARACTER),
    "profile_line_structure": _profile(LINE),
    "profile_lexical": _profile(LEXICAL),
    "profile_top_bigram": _profile(("top_ngram_fraction",)),
    "profile_gzip": profile_gzip,
    "governance_score": governance_score,
    "curate_heuristic": curate_heuristic,
    "curate_judge_stub": curate_judge_stub,
    "curate_budget": curate_budget,
    "curate_pages": curate_pages,
    "report_summary": report_summary,
    "report_by_source": report_by_source,
    "report_counts": report_counts,
    "responsibility": responsibility,
    "risk_grades": risk_grades,
    "cohort_stats": cohort_stats,
    "cohort_median_mad": cohort_median_mad,
    "cohort_outliers": cohort_outliers,
    "outliers_ksigma": outliers_ksigma,
    "outliers_reference": outliers_reference,
    "window_versions": window_versions,
    "window_stream": window_stream,
    "curate_with_outliers": curate_with_outliers,
    "series_ewma": series_ewma,
    "gates_combined": gates_combined,
    "record_gate": record_gate,
    "html_gate_pages": html_gate_pages,
    "ocr_gate_documents": ocr_gate_documents,
    "json_infer_schema": json_infer_schema,
    "json_gate_events": json_gate_events,
    "json_balanced": json_balanced,
    "provenance_ledger": provenance_ledger,
    "ledger_current": ledger_current,
    "ledger_versions": ledger_versions,
    "macro_f1_labels": macro_f1_labels,
    "binary_prf_labels": binary_prf_labels,
    "cascade_budget_curve": cascade_budget_curve,
    **{f"corrupt_{k}_{op}": _corrupted(k, op) for k, ops in mutate.CORRUPTORS.items() for op in ops},
    "mutation_eval": mutation_eval,
    "floor_upper": floor_upper,
    "guard_fpr": guard_fpr,
    "candidate_grid_objective": candidate_grid_objective,
    "accept_rule": accept_rule,
    "hillclimb_trajectory": hillclimb_trajectory,
    "clean_corpus": clean_corpus,
    "benchmark_export": benchmark_export,
    "naive_text": naive_text,
    "simple_reextract": simple_reextract,
    "daily_streams": daily_streams,
    "spc_throughput": _chart("throughput"),
    "spc_value_down": _chart("mean_value", "down"),
    "spc_events": spc_events,
    "routine_ticks": routine_ticks,
    "routine_stream": routine_stream,
    "baseline_gopher": baseline_gopher,
    "baseline_dict_oov": baseline_dict_oov,
    "baseline_parse_only": baseline_parse_only,
    "baseline_gzip": baseline_gzip,
}
