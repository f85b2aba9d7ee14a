"""Operator 3: personal data by patterns and by bootstrapped contexts, with DataFrame functions only.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. The tokens it covers are the seeds of a
bootstrap over all tokens that hold a digit or an @: the word before a token and its shape (letters, digits and signs
with runs collapsed) are its patterns. Spark counts the distinct tokens of each pattern and scores patterns and tokens
in turns: a pattern is worth the mean score of its tokens, a token the noisy-or of its patterns of enough support.
Unseen tokens that patterns of high confidence vouch for become spans of kind `context`; base spans always stay.

Positions are code points, ends exclusive. Possessive patterns keep the search linear on long runs. A null text counts
as empty; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import pin, row_key

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.9
#: Characters of the part of an address before the @.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold so that the pattern can match.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A part of at most 255 behind its leading zeros; nothing is left of one of zeros only. The span pattern ensures digits.
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
_TOKEN = r"[^\s0-9@]*+[0-9@]\S*+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    digits = F.transform(F.filter(F.split(F.reverse(_digits(x)), ""), lambda d: d != ""), value)
    return F.aggregate(digits, F.lit(0), lambda s, d: s + d) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {
        "email": F.lit(True),
        "ip": x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": n.between(14, 19) & _luhn(x),
        "phone": n.between(10, 15),
    }[kind]


def _keeps(kind: str):
    return lambda s: _holds(kind, s["found"])


def _named(rank: int, kind: str):
    """A span with its kind, in the order of sorting."""
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
    )


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def located(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Array of (start, end, found, before) of all matches; `before` is what lies between it and the one before."""
    none = F.array().cast("array<struct<between:string,found:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("between"), h.alias("found"))
    )
    if guard is not None:
        pairs = F.when(guard, pairs).otherwise(none)
    span = "array<struct<start:int,end:int,found:string,before:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["between"])
        end = start + F.char_length(pair["found"])
        one = F.struct(
            start.alias("start"), end.alias("end"), pair["found"].alias("found"), pair["between"].alias("before")
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).cast(span).alias("out"))

    return F.aggregate(pairs, begin, add, lambda s: s["out"])


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, doc, print, spans (start, rank of the kind, end, kind) and tokens of each row; no text is kept."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), row_key(text=text).alias("doc"), F.xxhash64(F.lit("text"), text).alias("print"), content.alias("t")
    )
    found = {}
    for kind in KINDS:
        hint = F.lit(True) if not _HINT[kind] else F.contains(F.col("t"), F.lit(_HINT[kind]))
        guard = hint if kind == "email" else hint & F.col("t").rlike("[0-9]")
        spans = F.filter(located(F.col("t"), PATTERNS[kind], guard), _keeps(kind))
        found[f"of_{kind}"] = spans
    guard = F.contains(F.col("t"), F.lit("@")) | F.col("t").rlike("[0-9]")
    rows = rows.withColumns(found | {"tokens": located(F.col("t"), _TOKEN, guard)})
    merged = F.concat(*[F.transform(f"of_{kind}", _named(rank, kind)) for rank, kind in enumerate(KINDS)])
    tokens = F.transform(
        "tokens",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["found"].alias("found"),
            F.lower(F.regexp_extract(F.right(s["before"], F.lit(60)), r"(\S+)\s+$", 1)).alias("word"),
        ),
    )
    return rows.select("doc_id", "doc", "print", F.array_sort(merged).alias("spans"), tokens.alias("tokens"))


def _candidates(found: DataFrame) -> DataFrame:
    """doc, print, start, end, token, seed and patterns of all tokens with a digit or an @, without closing signs."""
    each = found.select("doc", "print", "spans", F.explode("tokens").alias("x"))
    token = F.regexp_replace(F.col("x.found"), r"[^\p{L}\p{N}]++$", "")
    each = each.select("doc", "print", "spans", F.col("x.start").alias("start"), F.col("x.word").alias("word"), token.alias("token"))
    each = each.where(F.char_length("token") >= 6).withColumn("end", F.col("start") + F.char_length("token"))
    seed = F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", r"[0-9]++", "9"), r"[\p{Ll}]++", "a"), r"[\p{Lu}]++", "A")
    shape = F.concat(F.lit("shape:"), F.left(shape, F.lit(40)))
    word = F.when(F.col("word") != "", F.concat(F.lit("word:"), "word"))
    patterns = F.array_compact(F.array(shape, word))
    return each.select("doc", "print", "start", "end", "token", seed.alias("seed"), patterns.alias("patterns"))


def discovered(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Unseen tokens that confident patterns vouch for."""
    graph = candidates.select(F.explode("patterns").alias("pattern"), "token", "seed")
    graph = pin(graph.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    score = pin(graph.groupBy("token").agg(F.max("seed").alias("seed")))
    score = score.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        worth = graph.select("pattern", "token").join(score, "token").groupBy("pattern")
        worth = worth.agg(
            F.avg("score").alias("worth"), F.count("*").alias("tokens"), F.sum(F.col("seed").cast("int")).alias("seeds")
        )
        worth = worth.where((F.col("seeds") >= SUPPORT) & (F.col("worth") >= CONFIDENCE))
        vouch = graph.join(worth.select("pattern", "worth"), "pattern").groupBy("token")
        vouch = vouch.agg((1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))).alias("vouched"))
        score = score.join(vouch, "token", "left").select(
            "token", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("vouched", F.lit(0.0))).alias("score")
        )
        score = pin(score)
    return score.where(~F.col("seed") & (F.col("score") >= CONFIDENCE)).select("token")


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, doc, print, base and spans (all of them) of each row, in order of start and kind."""
    found = pin(base_spans(docs, text))
    candidates = _candidates(found)
    new = discovered(candidates)
    rank = F.lit(len(KINDS)).alias("rank")
    more = candidates.where(~F.col("seed")).join(new, "token").groupBy("doc", "print")
    more = more.agg(F.collect_set(F.struct("start", rank, "end", F.lit("context").alias("kind"))).alias("more"))
    joined = found.join(more, ["doc", "print"], "left")
    every = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more")))
    return joined.select("doc_id", "doc", "print", F.col("spans").alias("base"), every.alias("spans"))


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind in brackets."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        name = F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        apart = (s["start"] >= state["at"]) | (F.size(state["out"]) == 0)
        out = F.when(apart, F.concat(state["out"], F.array(name))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    def end(state: Column) -> Column:
        rest = F.substring(text, state["at"] + 1, F.char_length(text))
        return F.concat(F.array_join(state["out"], ""), rest)

    return F.aggregate(spans, begin, step, end)
