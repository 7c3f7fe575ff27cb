"""Secret scans with character Markov models, in DataFrame expressions only.

Fixed patterns give the base spans. Further spans are runs of token
characters that a first-order Markov model of random strings explains better
than one of ordinary identifiers; both models are bigram tables counted from
labelled samples. Models judge what the base spans leave of a text.

Defined cases: null text is empty; an empty text or one without a match has
no spans and the digest of the empty string; repeated rows each get their own
row; without samples of both kinds the models add nothing; an empty table
gives an empty result; further columns of the input may have any name. Time
and memory follow a text's length, whatever the length of its runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import free_name

#: Fixed patterns: kind, pattern, group that is measured, its least length in characters.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A cheap test that holds wherever a match of the kind can be kept.
MAY_HAVE = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: The same matches where short ones cannot hide a longer one.
WHOLE_RUN = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LOW, SIDE = 43, 80  # code points 43 to 122 hold all candidate characters
BLOCK = 1024
BACKOFF = 8.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, state: str, out: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<out> of ``step(state, item)`` for each item, with the state that the items before it leave.

    The results are gathered block by block, which keeps a text with many
    thousand items linear.
    """
    one = f"array<{out}>"

    def block(begin: Column, part: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            after, found = step(a["state"], x)
            return F.struct(after.cast(state).alias("state"), F.array_append(a["out"], found).cast(one).alias("out"))

        return F.aggregate(part, F.struct(begin.cast(state).alias("state"), F.array().cast(one).alias("out")), add)

    def whole(all_items: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int")),
            F.struct(start.cast(state).alias("state"), F.array().cast(f"array<{one}>").alias("out")),
            lambda a, k: _let(block(a["state"], F.slice(all_items, k * BLOCK + 1, BLOCK)), lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).cast(f"array<{one}>").alias("out"))),
        )

    return _let(items, lambda all_items: F.when(F.size(all_items) == 0, F.array().cast(one)).otherwise(F.flatten(whole(all_items)["out"])))


def located(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e>> of the leftmost matches whose group has ``least`` characters; code points.

    Text between matches and the matches alternate, so running lengths give
    places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"))),
        measured,
        lambda x, m: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (F.length(m) >= least).alias("keep")),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + F.coalesce(x["len"], F.lit(0))
        return end, F.struct((at + x["gap"]).alias("s"), end.alias("e"), F.coalesce(x["keep"], F.lit(False)).alias("keep"))

    spans = running(parts, "int", "struct<s:int,e:int,keep:boolean>", F.lit(0), step)
    return F.transform(F.filter(spans, lambda x: x["keep"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def merged(spans: Column) -> Column:
    """The union of ``spans`` as sorted spans; overlapping ones become one, touching ones stay apart."""
    marked = running(
        F.array_sort(spans),
        "int",
        "struct<s:int,fresh:boolean,upto:int>",
        F.lit(0),
        lambda upto, x: (F.greatest(upto, x["e"]), F.struct(x["s"].alias("s"), (x["s"] >= upto).alias("fresh"), F.greatest(upto, x["e"]).alias("upto"))),
    )

    def joined(items: Column) -> Column:
        starts = F.filter(items, lambda x: x["fresh"])
        last = F.zip_with(items, F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), lambda x, after: F.struct(x["upto"].alias("e"), F.coalesce(after["fresh"], F.lit(True)).alias("last")))
        return F.zip_with(starts, F.filter(last, lambda x: x["last"]), lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))

    return F.when(F.size(spans) == 0, _none()).otherwise(_let(marked, joined))


def replaced(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """``text`` with each of the ``merged`` spans replaced by ``fill`` of it; time follows the text's length."""

    def put(parts: Column) -> Column:
        own = parts["spans"]
        begins = F.concat(F.array(F.lit(0)), F.transform(own, lambda x: x["e"]))
        ends = F.concat(F.transform(own, lambda x: x["s"]), F.array(F.size(parts["chars"])))
        gaps = F.zip_with(begins, ends, lambda b, e: F.array_join(F.slice(parts["chars"], b + 1, e - b), ""))
        return F.array_join(F.zip_with(gaps, F.transform(own, fill), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(F.split(text, "").alias("chars"), spans.alias("spans")), put))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int>>")


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for kind, pattern, group, least in BASE:
        out[kind] = F.when(text.rlike(MAY_HAVE[kind]), located(text, WHOLE_RUN.get(kind, pattern), group, least)).otherwise(_none())
    return out


# ---- the models


def bigrams(token: Column) -> Column:
    """The bigrams of a token of candidate characters as numbers below ``SIDE * SIDE``; the token is cut into characters once."""

    def pairs(codes: Column) -> Column:
        return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * SIDE + b)

    return F.when(F.length(token) < 2, F.array().cast("array<int>")).otherwise(_let(F.transform(F.split(token, ""), lambda c: F.ascii(c) - LOW), pairs))


def fit(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each bigram, from ``samples(token, random)``; None without both kinds.

    The counts of at most 2 * 80 * 80 bigrams come to the driver.
    """
    pairs = samples.select("random", F.explode(bigrams(F.col("token"))).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for random, pair, n in pairs.where(F.col("pair").between(0, SIDE * SIDE - 1)).groupBy("random", "pair").count().collect():
        counts[random][pair] = n
    if not counts[True] or not counts[False]:
        return None
    logs = {}
    for random, own in counts.items():
        before, after = [0.0] * SIDE, [0.0] * SIDE
        for pair, n in own.items():
            before[pair // SIDE] += n
            after[pair % SIDE] += n
        alone = [(n + 0.5) / (sum(after) + 0.5 * SIDE) for n in after]  # a bigram that was never seen falls back on its character
        logs[random] = [math.log((own.get(p, 0) + BACKOFF * alone[p % SIDE]) / (before[p // SIDE] + BACKOFF)) for p in range(SIDE * SIDE)]
    return [round(a - b, 4) for a, b in zip(logs[True], logs[False], strict=True)]


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a token's bigrams."""
    return F.aggregate(bigrams(token), F.lit(0.0), lambda a, p: a + F.element_at(model, p + 1)) / (F.length(token) - 1)


def model_spans(text: Column, model: list[float] | None, least_ratio: float) -> Column:
    """Spans of candidate runs that read as random strings."""
    if model is None:
        return _none()
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    pairs = F.zip_with(located(text, CANDIDATE, 0, 16), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda x, t: F.struct(x["s"].alias("s"), x["e"].alias("e"), t.alias("t")))
    kept = F.filter(pairs, lambda x: ratio(x["t"], table) >= least_ratio)
    return F.when(text.rlike(CANDIDATE), F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).otherwise(_none())


def labelled_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> DataFrame:
    """``(token, random)``: what the fixed patterns find in any document is random.

    Words of 8 letters or more that hold no digit are ordinary; they come from
    about ``most_rows`` documents, those with the lowest hashes.
    """
    rows = docs.count()
    bound = int(2**31 * min(1.0, most_rows / max(1, rows)))
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**31)) < bound).alias("words"))
    none = F.array().cast("array<string>")
    kept = lambda kind, pattern, group: F.when(F.col("t").rlike(MAY_HAVE[kind]), F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).otherwise(none)
    secret = F.concat(kept("assign", BASE[0][1], 2), kept("access", WHOLE_RUN["access"], 0), kept("hex", WHOLE_RUN["hex"], 0))
    words = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{8,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    plain = F.when(F.col("words"), words).otherwise(none)
    kinds = F.concat(
        F.transform(F.filter(secret, lambda x: F.length(x) >= 12), lambda x: F.struct(x.alias("token"), F.lit(True).alias("random"))),
        F.transform(plain, lambda x: F.struct(x.alias("token"), F.lit(False).alias("random"))),
    )
    return own.select(F.inline(kinds))


def scan(docs: DataFrame, model: list[float] | None, *, text_col: str = "text", least_ratio: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and, as the last column, struct<text, assign, access, hex, markov> with all spans.

    The last column's name is ``found``, lengthened where ``keep`` has it.
    Models look at the text with its base spans blanked out, so the parts of a
    run that lie outside them are judged on their own.
    """
    keep = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep]
    n = {k: free_name(f"_{k}", keep) for k in ("text", "assign", "access", "hex", "rest", "markov")}
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Each step is a column of its own: Spark then works it out once.
    one = docs.select(*kept, text.alias(n["text"]), *[c.alias(n[k]) for k, c in base_spans(text).items()])
    base = merged(F.concat(*[F.col(n[k]) for k in ("assign", "access", "hex")]))
    two = one.select("*", replaced(F.col(n["text"]), base, lambda x: F.repeat(F.lit(" "), x["e"] - x["s"])).alias(n["rest"]))
    three = two.select("*", model_spans(F.col(n["rest"]), model, least_ratio).alias(n["markov"]))
    return three.select(*kept, F.struct(*[F.col(n[k]).alias(k) for k in ("text", "assign", "access", "hex", "markov")]).alias(free_name("found", keep)))


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of these kinds of ``found``, by start, then kind as listed."""

    def tagged_as(n: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"))

    tagged = F.concat(*[F.transform(found[k], tagged_as(n)) for n, k in enumerate(kinds)])
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(tagged), lambda x: F.concat_ws(":", F.element_at(names, x["n"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, model: list[float] | None, *, text_col: str = "text", mark: str = "[SECRET]", least_ratio: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in its text; overlapping spans become one mark. Null text stays null."""
    found = scan(docs, model, text_col=text_col, least_ratio=least_ratio)
    own, spans = F.col(f"`{found.columns[-1]}`"), free_name("spans", found.columns)
    marked = found.select("*", merged(F.concat(own["assign"], own["access"], own["hex"], own["markov"])).alias(spans))
    clean = F.when(F.size(spans) > 0, replaced(own["text"], F.col(spans), lambda x: F.lit(mark))).otherwise(F.col(f"`{text_col}`"))
    return marked.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
