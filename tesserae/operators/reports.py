"""Usage and cost, logs, tables as markdown, scenario results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Price in dollars per million tokens in and out, Wh and grams of CO2 per token, tier.
PRICES = [
    ("gpt-4o", 2.50, 10.00, 0.0015, 0.0008, "high"),
    ("gpt-4o-mini", 0.15, 0.60, 0.0008, 0.0004, "low"),
    ("gpt-4.1", 3.00, 12.00, 0.0016, 0.0009, "high"),
    ("gpt-4.1-mini", 0.20, 0.80, 0.0009, 0.0005, "low"),
    ("o1", 15.00, 60.00, 0.0018, 0.0010, "high"),
    ("o1-mini", 3.00, 12.00, 0.0012, 0.0006, "low"),
    ("o3", 15.00, 75.00, 0.0020, 0.0011, "high"),
    ("o3-mini", 3.50, 14.00, 0.0013, 0.0007, "low"),
    ("llama-3.3-70b-versatile", 0.10, 0.30, 0.0010, 0.0005, "low"),
    ("meta-llama/llama-4-scout-17b-16e-instruct", 0.40, 0.80, 0.0012, 0.0006, "low"),
]
#: Tokens per day by tier.
DAILY_LIMITS = [("high", 250_000), ("low", 2_500_000)]
#: Models listed by tier, with or without a price.
TIERS = {
    "high": ["gpt-4.5-preview", "gpt-4.1", "gpt-4o", "o1", "o3"],
    "low": ["gpt-4.1-mini", "gpt-4.1-nano", "gpt-4o-mini", "o1-mini", "o3-mini", "o4-mini", "codex-mini-latest", "llama-3.3-70b-versatile", "meta-llama/llama-4-scout-17b-16e-instruct"],
}
#: Provider, task, subtask (empty: none) and model; the task "default" is for all others.
MODELS = [
    ("openai", "pdf_parsing", "vision", "gpt-4.1-mini"),
    ("openai", "pdf_parsing", "text", "gpt-4.1-mini"),
    ("openai", "chunking", "", "gpt-4.1-mini"),
    ("openai", "requirement_extraction", "", "gpt-4.1-mini"),
    ("openai", "deduplication", "", "gpt-4.1-mini"),
    ("openai", "default", "", "gpt-4.1-mini"),
    ("groq", "pdf_parsing", "vision", "meta-llama/llama-4-scout-17b-16e-instruct"),
    ("groq", "pdf_parsing", "text", "llama-3.3-70b-versatile"),
    ("groq", "chunking", "", "llama-3.3-70b-versatile"),
    ("groq", "requirement_extraction", "", "llama-3.3-70b-versatile"),
    ("groq", "deduplication", "", "llama-3.3-70b-versatile"),
    ("groq", "default", "", "llama-3.3-70b-versatile"),
]


def usage_per_day(calls: DataFrame) -> DataFrame:
    """Sums per day and model of calls ``date, model, input_tokens, output_tokens``: each call counts once."""
    sums = calls.groupBy("date", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def with_prices(usage: DataFrame) -> DataFrame:
    """Cost, energy and CO2 of usage rows, by each row's model; null for one without a price.

    The tier is that of the list, else that of the price, else low.
    """
    priced = {p[0]: p[1:] for p in PRICES}
    listed = {m: tier for tier, models in TIERS.items() for m in models}
    known = [(m, *priced.get(m, (None, None, None, None, None))[:4], listed.get(m) or priced[m][4]) for m in sorted({*priced, *listed})]
    prices = F.broadcast(usage.sparkSession.createDataFrame(known, "_model string, _in double, _out double, _energy double, _co2 double, tier string"))
    joined = usage.join(prices, F.col("model") == F.col("_model"), "left")
    cost = (F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out")) / 1e6
    energy, co2 = F.col("total_tokens") * F.col("_energy"), F.col("total_tokens") * F.col("_co2")
    return joined.select(*usage.columns, F.round(cost, 6).alias("cost"), F.round(energy, 6).alias("energy_wh"), F.round(co2, 6).alias("co2_g"), F.coalesce("tier", F.lit("low")).alias("tier"))


def model_for_task(tasks: DataFrame) -> DataFrame:
    """``tasks`` (``provider, task, sub_task``) with ``model``: that of the subtask, else of the task,
    else the provider's default; an unknown provider is the first one."""
    models = F.broadcast(tasks.sparkSession.createDataFrame(MODELS, "_provider string, _task string, _sub string, _model string"))
    first = MODELS[0][0]
    names = sorted({m[0] for m in MODELS})
    provider = F.when(F.col("provider").isin(*names), F.col("provider")).otherwise(F.lit(first))
    at = lambda task, sub, name: models.select(F.col("_provider").alias(f"p{name}"), F.col("_task").alias(f"t{name}"), F.col("_sub").alias(f"s{name}"), F.col("_model").alias(name)).filter((F.col(f"t{name}") == task) if task is not None else F.lit(True)).filter((F.col(f"s{name}") == sub) if sub is not None else F.lit(True))
    exact, whole, default = at(None, None, "exact"), at(None, "", "whole"), at("default", "", "other")
    keyed = tasks.withColumn("_p", provider).withColumn("_s", F.coalesce("sub_task", F.lit("")))
    found = keyed.join(exact, (F.col("_p") == F.col("pexact")) & (F.col("task") == F.col("texact")) & (F.col("_s") == F.col("sexact")), "left")
    found = found.join(whole, (F.col("_p") == F.col("pwhole")) & (F.col("task") == F.col("twhole")), "left").join(default, F.col("_p") == F.col("pother"), "left")
    return found.select(*tasks.columns, F.coalesce("exact", "whole", "other").alias("model"))


def usage_on(usage: DataFrame, day: str) -> DataFrame:
    """``model, input_tokens, output_tokens, total_tokens`` of one day, and the sums with a null model."""
    own = usage.filter(F.col("date") == F.lit(day).cast("date"))
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")]
    return own.rollup("model").agg(*sums)


def tier_limits(usage: DataFrame) -> DataFrame:
    """Tokens per day and tier against the limit, in percent, with a warning above 80."""
    limits = F.broadcast(usage.sparkSession.createDataFrame(DAILY_LIMITS, "_tier string, token_limit long"))
    used = with_prices(usage).groupBy("date", "tier").agg(F.sum("total_tokens").alias("used"))
    share = F.round(100 * F.col("used") / F.col("token_limit"), 4)
    return used.join(limits, F.col("tier") == F.col("_tier")).select("date", "tier", "used", "token_limit", share.alias("percent"), (share > 80).alias("warning"))


def sections(lines: DataFrame, marker: str) -> DataFrame:
    """Lines ``source, line_no, text`` with the marker line that opens their section (null before one)."""
    opened = F.when(F.col("text").rlike(marker), F.col("line_no"))
    return lines.withColumn("section", F.max(opened).over(Window.partitionBy("source").orderBy("line_no")))


def markdown_table(sheet: DataFrame) -> DataFrame:
    """``row_no, line`` of a sheet ``row_no, cells``: padded columns, a rule after the first row."""
    clean = sheet.select("row_no", F.transform("cells", lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\n\r\t]", " ")).alias("cells"))
    cells = clean.select("row_no", F.posexplode("cells").alias("i", "cell"))
    widths = cells.groupBy("i").agg(F.max(F.length("cell")).alias("w"))
    layout = widths.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("ws"))
    joined = clean.join(F.broadcast(layout))
    padded = F.transform("ws", lambda w, i: F.rpad(F.coalesce(F.get("cells", i), F.lit("")), w, " "))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("ws", lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    least = clean.agg(F.min("row_no").alias("least"))
    rows = joined.join(F.broadcast(least)).select("row_no", F.when(F.col("row_no") == F.col("least"), F.array(line, rule)).otherwise(F.array(line)).alias("ls"))
    return rows.select("row_no", F.posexplode("ls").alias("part", "line"))


def log_flags(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per section whether any line matches each pattern."""
    return lines.groupBy("source", "section").agg(*[F.bool_or(F.col("text").rlike(p)).alias(name) for name, p in patterns.items()])


def latest_runs(results: DataFrame) -> DataFrame:
    """The newest result per scenario of ``scenario_id, ts, passed``."""
    return results.groupBy("scenario_id").agg(F.max("ts").alias("ts"), F.max_by("passed", "ts").alias("passed"))


def scenario_rates(results: DataFrame) -> DataFrame:
    """``scenario_id, runs, passed, rate`` of ``scenario_id, passed``; a null result hasn't passed."""
    passed = F.sum(F.coalesce(F.col("passed"), F.lit(False)).cast("long"))
    return results.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("runs"), passed.alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("runs"), 6))


def scenario_table(lines: DataFrame, document: str, passed: str, failed: str) -> DataFrame:
    """``source, section, documents, passed`` of log lines ``source, section, line_no, text``.

    ``document`` is a pattern whose first group is a document's name: the distinct ones, in the
    order in which they come up, by commas.  A section passes if a line matches ``passed`` and none ``failed``.
    """
    told = lines.withColumn("doc", F.nullif(F.regexp_extract("text", document, 1), F.lit("")))
    each = told.groupBy("source", "section", "doc").agg(F.min("line_no").alias("at"), F.bool_or(F.col("text").rlike(passed)).alias("p"), F.bool_or(F.col("text").rlike(failed)).alias("f"))
    named = F.filter(F.array_sort(F.collect_list(F.struct("at", "doc"))), lambda x: x["doc"].isNotNull())
    return each.groupBy("source", "section").agg(F.array_join(F.transform(named, lambda x: x["doc"]), ",").alias("documents"), (F.bool_or("p") & ~F.bool_or("f")).alias("passed"))


def mismatches(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``key, column, expected, actual`` where asserted values differ; null asserts nothing."""
    columns = [c for c in expected.columns if c != key]
    joined = expected.alias("e").join(actual.alias("a"), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"e.{c}").cast("string").alias("expected"), F.col(f"a.{c}").cast("string").alias("actual")) for c in columns])
    return joined.select(key, F.inline(pairs)).filter("expected IS NOT NULL AND NOT (expected <=> actual)")


def upsert_usage(ledger: DataFrame, calls: DataFrame) -> DataFrame:
    """The daily ledger with new calls added: one row per day and model."""
    return usage_per_day(ledger.select("date", "model", "input_tokens", "output_tokens").unionByName(calls.select("date", "model", "input_tokens", "output_tokens")))


#: The log's summary lines by kind, the first that matches counts.
LOG_COUNTS = {
    "new": [r"New unique chunks: (\d+)", r"(\d+) new chunks"],
    "duplicate": [r"Exact duplicates found: (\d+)", r"(\d+) duplicate chunks"],
    "similar": [r"Similar chunks found: (\d+)", r"(\d+) similar chunks"],
    "updated": [r"(\d+) updated chunks"],
}


def log_counts(sections: DataFrame) -> DataFrame:
    """Chunk counts per kind from section texts ``section, text``; null where no pattern matches."""
    first = lambda patterns: F.coalesce(*[F.expr(f"try_cast(nullif(regexp_extract(text, r'{p}', 1), '') AS bigint)") for p in patterns])
    return sections.select("section", *[first(p).alias(kind) for kind, p in LOG_COUNTS.items()])


def capability_summary(counted: DataFrame) -> DataFrame:
    """Whether any section has each kind of chunk."""
    return counted.agg(*[F.coalesce(F.bool_or(F.col(k) > 0), F.lit(False)).alias(f"any_{k}") for k in LOG_COUNTS])


#: Lineage columns and what a summary calls them.
LINEAGE = (("duplicate_of", "duplicate of"), ("replaced_by", "replaced by"), ("previous_chunk_id", "before"), ("aligned_with_chunk_id", "aligned with"), ("aligned_with_document_id", "aligned with document"))


def chunk_summaries(chunks: DataFrame) -> DataFrame:
    """One line per chunk: id, document, its first 150 characters, and the lineage fields that the table has
    and the chunk sets."""
    told = [F.concat(F.lit(f"{name} "), F.nullif(F.col(c).cast("string"), F.lit(""))) for c, name in LINEAGE if c in chunks.columns]
    return chunks.select("chunk_id", F.concat_ws(" | ", "chunk_id", F.col("document_id").cast("string"), F.substring("chunk_text", 1, 150), *told).alias("line"))


def html_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report page of an aggregated result; it shows up to ``limit`` rows, and says so if there are more."""
    from html import escape

    rows = df.limit(limit + 1).collect()
    more = f"<p>The first {limit} rows of {df.count()}.</p>" if len(rows) > limit else ""

    cells = lambda row, tag: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in row)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows[:limit])
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{cells(df.columns, 'th')}</tr>{body}</table>{more}</body></html>"
