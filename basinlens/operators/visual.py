"""Photo-match scoring, recovery of JSON from model text, and the provider job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinlens import constants as C
from basinlens.session import cut_lineage


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visual_score(match="matches_declared", confidence="confidence") -> Column:
    m, c, p = _col(match), _col(confidence), C.VISUAL_POINTS
    yes = (
        F.when(c >= C.CONFIDENCE_HIGH, p["yes_high"])
        .when(c >= C.CONFIDENCE_MEDIUM, p["yes_medium"])
        .otherwise(p["yes_low"])
    )
    return F.when(m == "yes", yes).when(m == "uncertain", p["uncertain"]).when(m == "no", p["no"])


def needs_review(match="matches_declared", confidence="confidence") -> Column:
    return (_col(confidence) < C.CONFIDENCE_REVIEW) | (_col(match) == "uncertain")


def review_flags(match="matches_declared", confidence="confidence") -> Column:
    m, gated = _col(match), needs_review(match, confidence)
    flags = F.array(
        F.when(m == "no", F.lit("activity_mismatch")),
        F.when(gated & (m == "uncertain"), F.lit("uncertain_match_review")),
        F.when(gated & (m != "uncertain"), F.lit("low_confidence_review")),
    )
    return F.filter(flags, lambda x: x.isNotNull())


# --- JSON in model text ---------------------------------------------------------

_END = "#end"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def json_object(text) -> Column:
    """The text itself when all of it is one JSON object, else null.

    The parser stops after the first value, so the text is parsed inside an array
    with a closing mark: anything left over breaks the array.
    """

    def whole(parsed: Column) -> Column:
        starts = F.schema_of_variant(parsed[0]).startswith("OBJECT")
        return (F.size(parsed) == 2) & starts & (F.variant_get(parsed[1], "$", "string") == _END)

    def check(t: Column) -> Column:
        wrapped = F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{_END}"]')))
        items = F.variant_get(wrapped, "$", "array<variant>")
        return F.when(t.startswith("{") & F.exists(F.array(items), whole), t)

    return _let(_col(text), check)


def fenced_block(text) -> Column:
    """Content of the first ``` block (optionally tagged json)."""
    body = F.regexp_extract(_col(text), r"(?is)```(?:json)?\s*(.*?)```", 1)
    return F.nullif(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(""))


def balanced_block(text) -> Column:
    """From the first ``{`` to the brace that closes it; null when it never closes.

    The text is cut after each brace and the pieces are folded into (depth, length),
    so the work grows with the number of braces.
    """
    t = _col(text)
    start = F.instr(t, "{")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        closes = piece.endswith("}") & (depth == 0)
        return F.when(acc["done"], acc).otherwise(
            F.struct(depth.alias("depth"), (acc["length"] + F.length(piece)).alias("length"), closes.alias("done"))
        )

    def cut(tail: Column) -> Column:
        found = F.aggregate(F.split(tail, r"(?<=[{}])"), begin, step)
        return _let(found, lambda f: F.when(f["done"], F.substring(tail, F.lit(1), f["length"])))

    return _let(F.when(start > 0, F.substring(t, start, F.length(t))), cut)


def extract_json_object(text) -> Column:
    """First of: the whole text, its first fenced block, its first balanced block, that is a JSON object."""
    return _let(
        F.regexp_replace(_col(text), r"^\s+|\s+$", ""),
        lambda t: F.coalesce(json_object(t), json_object(fenced_block(t)), json_object(balanced_block(t))),
    )


# --- strict response schema -------------------------------------------------------

def response_fields(raw="raw_json") -> Column:
    """All fields of a response as ``map<string,variant>``, in one parse, so JSON types stay; null for other text."""
    return F.from_json(_col(raw), "map<string,variant>")


def parse_response(fields="fields", fill_evidence: bool = False) -> Column:
    """``struct`` of the eight response fields, from ``response_fields``.

    ``fill_evidence`` puts the fixed text in place of a blank justification, which is
    what the adapter for local models does; the strict schema itself refuses blanks.
    """
    m = _col(fields)

    def field(k: str) -> Column:
        found = F.try_element_at(m, F.lit(k))
        if k == "confidence":
            # a number, or text that reads as one
            return F.try_variant_get(found, "$", "double").alias(k)
        value = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))
        if k == "evidence" and fill_evidence:
            blank = value.isNotNull() & (F.trim(value) == "")
            return F.when(blank, F.lit(C.EMPTY_EVIDENCE_TEXT)).otherwise(value).alias(k)
        return value.alias(k)

    return F.struct(*[field(k) for k in C.RESPONSE_KEYS])


def response_errors(fields="fields", parsed="parsed") -> Column:
    """Reasons a response breaks the strict schema; empty when it is valid."""
    m, r = _col(fields), _col(parsed)

    def outside(k: str, allowed: list[str]) -> Column:
        return F.when(~F.coalesce(r[k].isin(allowed), F.lit(False)), F.lit(f"{k} is not an allowed value"))

    def length(k: str, top: int) -> Column:
        ok = F.length(r[k]).between(1, top)
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{k} must have 1 to {top} characters"))

    keys = F.map_keys(m)
    expected = F.array(*[F.lit(k) for k in C.RESPONSE_KEYS])
    extra = F.array_sort(F.array_except(keys, expected))
    missing = F.array_except(expected, keys)
    rules = F.array(
        F.when(m.isNull(), F.lit("not a JSON object")),
        F.when(F.size(extra) > 0, F.concat(F.lit("unexpected fields: "), F.array_join(extra, ", "))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))),
        outside("predicted_category", [*C.CATEGORY_CODES, C.UNKNOWN_CODE]),
        length("predicted_activity", 200),
        outside("construction_stage", C.CONSTRUCTION_STAGES),
        outside("water_visible", C.WATER_VISIBLE),
        outside("vegetation_cover", C.VEGETATION_COVER),
        outside("matches_declared", C.MATCH_RESULTS),
        F.when(~F.coalesce(r["confidence"].between(0.0, 1.0), F.lit(False)), F.lit("confidence must lie in 0 to 1")),
        length("evidence", 500),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def check_responses(df: DataFrame, raw: str = "raw_json", fill_evidence: bool = False) -> DataFrame:
    """Adds ``parsed`` and ``response_errors``."""
    fields = df.withColumn("_fields", response_fields(raw))
    parsed = fields.withColumn("parsed", parse_response("_fields", fill_evidence))
    return parsed.withColumn("response_errors", response_errors("_fields", "parsed")).drop("_fields")


def invalid_response(reason: Column, attempts: Column) -> Column:
    """The honest stand-in for a response that never became valid."""
    evidence = F.concat(
        F.lit(f"{C.INVALID_EVIDENCE_PREFIX} after "),
        attempts.cast("string"),
        F.lit(" attempt(s): "),
        F.substring(reason, 1, C.INVALID_REASON_MAX),
    )
    values = {
        "predicted_category": F.lit(C.UNKNOWN_CODE),
        "predicted_activity": F.lit(C.INVALID_ACTIVITY_TEXT),
        "construction_stage": F.lit("unclear"),
        "water_visible": F.lit("unclear"),
        "vegetation_cover": F.lit("unclear"),
        "matches_declared": F.lit("uncertain"),
        "confidence": F.lit(0.0),
        "evidence": evidence,
    }
    return F.struct(*[values[k].alias(k) for k in C.RESPONSE_KEYS])


def validate_or_degrade(
    df: DataFrame, raw: str = "raw_json", attempts: int = 2, fill_evidence: bool = False
) -> DataFrame:
    """Adds ``result`` (valid response or its stand-in), ``response_errors``, score, gate and flags.

    A column ``attempts`` (from ``classify``) says how often a row was asked; without one
    it is the constant.
    """
    checked = check_responses(df, raw, fill_evidence)
    bad = F.size("response_errors") > 0
    reason = F.coalesce(F.array_join("response_errors", "; "), F.lit("unknown error"))
    asked = F.col("attempts") if "attempts" in df.columns else F.lit(attempts)
    result = F.when(bad, invalid_response(reason, asked)).otherwise(F.col("parsed"))
    return score_result(checked.withColumn("result", result).drop("parsed"))


def score_result(df: DataFrame) -> DataFrame:
    m, c = F.col("result.matches_declared"), F.col("result.confidence")
    return (
        df.withColumn("visual_score", visual_score(m, c))
        .withColumn("needs_review", needs_review(m, c))
        .withColumn("review_flags", review_flags(m, c))
    )


# --- provider job -------------------------------------------------------------------

Provider = Callable[[dict[str, Any]], str]


def classify(
    df: DataFrame, make_provider: Callable[[], Provider], attempts: int = 2, raw: str = "raw_json", fill_evidence: bool = False
) -> DataFrame:
    """Run a classifier over the rows: adds ``raw_json`` (last answer), ``error`` and ``attempts``.

    ``make_provider`` is called once per task and returns ``row -> response text``; the row
    carries the number of the ``attempt``.  An exception is kept as the row's ``error`` and
    the batch goes on.  Rows whose call failed, or whose answer breaks the response schema,
    are asked again, up to ``attempts`` times in all.  Each round is checkpointed, so an
    answer is paid for once.
    """
    added = [T.StructField(raw, T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())]
    schema = T.StructType([*df.schema.fields, *added])

    def ask(attempt: int) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            provider = make_provider()

            def answer(row: dict[str, Any]) -> tuple[str | None, str | None]:
                try:
                    return provider(row | {"attempt": attempt}), None
                except Exception as exc:  # one bad row must not lose the batch
                    return None, str(exc)

            for batch in batches:
                answers = [answer(row) for row in batch.to_dict("records")]
                yield batch.assign(**{raw: [a for a, _ in answers], "error": [e for _, e in answers], "attempts": attempt})

        return run

    done: list[DataFrame] = []
    waiting = df
    for attempt in range(1, attempts + 1):
        answered = cut_lineage(waiting.mapInPandas(ask(attempt), schema))
        if attempt == attempts:
            done.append(answered)
            break
        checked = check_responses(answered, raw, fill_evidence).drop("parsed")
        valid = F.size("response_errors") == 0
        done.append(checked.where(valid).drop("response_errors"))
        waiting = checked.where(~valid).select(*df.columns)
    return reduce(DataFrame.unionByName, done)
