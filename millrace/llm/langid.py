"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages: each slot is a row of
bits, one per language, stored in planes of eight languages, as many as there
are languages. It has two to four slots an n-gram. Looking up an
n-gram ands its slots and yields all languages that contain it. Per-language
counts over a text, corrected for the filter's false positives, decide.

N-grams are byte windows of the lower-cased UTF-8 text with ASCII non-letters
as blanks. A language contains an n-gram if it uses it at least
``least_share`` times as often as the language that uses it most.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
a text whose n-grams no language knows gets the most frequent language;
without training rows everything is ``und``; repeated rows each get a row; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

GRAM = 5
BLOCK_BITS = 12
MOST_SLOT_BITS = 26
#: Odd multipliers of the slot hashes.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
STEP = 1 << 18
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    planes: np.ndarray  # (planes, slots) uint8
    false_rate: list[float]
    slot_bits: int
    gram: int = GRAM


def grams(text: str, n: int) -> Iterator[np.ndarray]:
    """Windows of ``n`` bytes as unsigned longs, in bounded runs."""
    data = np.frombuffer(b"  " + text.lower().encode("utf-8", "replace").translate(_BLANKS) + b"   ", np.uint8)
    for begin in range(0, max(1, len(data) - n + 1), STEP):
        part = data[begin : begin + STEP + n - 1]
        out = part[: len(part) - n + 1].astype(np.uint64)
        for i in range(1, n):
            out <<= np.uint64(8)
            out |= part[i : len(part) - n + 1 + i]
        yield out


def slots(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(values * np.uint64(h)) >> np.uint64(64 - bits) for h in HASHES]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_rows: int = 2000, gram: int = GRAM, least_share: float = 0.3, least_count: int = 2, id_col: str = "doc_id") -> Model | None:
    """Fit on about ``most_rows`` rows of each language: those with the lowest hashes of their ids.

    What reaches the driver is the table of languages and the filter itself,
    of at most 2**MOST_SLOT_BITS bytes for each eight languages.
    """
    own = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not rows:
        return None
    languages = [r["lang"] for r in rows]
    number = {lang: i for i, lang in enumerate(languages)}
    bounds = F.create_map(*[F.lit(x) for r in rows for x in (r["lang"], int(2**31 * min(1.0, most_rows / r["count"])))])
    sample = own.where(F.pmod(F.xxhash64("id"), F.lit(2**31)) < F.element_at(bounds, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                held: list[np.ndarray] = []
                for i, name in enumerate(langs):
                    if name == lang:
                        held.extend(grams(batch.column(0)[i].as_py(), gram))
                    if held and (sum(map(len, held)) > 4 * STEP or i == len(langs) - 1):
                        values, n = np.unique(np.concatenate(held), return_counts=True)
                        held = []
                        yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(values), pa.int32()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = written(sample.select("text", "lang").mapInArrow(count, "lang int, gram long, n long"), "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    share = share.withColumn("p", F.col("n") / F.element_at(F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(languages))]), F.col("lang") + 1))
    most = share.groupBy("gram").agg(F.max("p").alias("most"), F.collect_list(F.struct("lang", "p")).alias("all"))  # a list has a place a language
    kept = written(most.select("gram", F.transform(F.filter("all", lambda x: x["p"] >= F.col("most") * least_share), lambda x: x["lang"]).alias("langs")), "kept")
    bits = max(16, min(MOST_SLOT_BITS, (2 * kept.count()).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1)
            for s in slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)).take(pa.array(np.repeat(np.arange(len(s)), langs.value_lengths().to_numpy(zero_copy_only=False)))), langs.flatten()], names=["slot", "lang"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        """A run of slots of one plane; how many n-grams fall in it follows from the filter's size."""
        out = np.zeros(1 << BLOCK_BITS, np.uint8)
        np.bitwise_or.at(out, rows["slot"].to_numpy() & ((1 << BLOCK_BITS) - 1), np.left_shift(1, rows["lang"].to_numpy() % 8).astype(np.uint8))
        return pd.DataFrame({"plane": [rows["lang"].iloc[0] // 8], "block": [rows["slot"].iloc[0] >> BLOCK_BITS], "bits": [out.tobytes()]})

    dealt = kept.mapInArrow(spread, "slot int, lang int")
    blocks = dealt.groupBy(F.floor(F.col("lang") / 8), F.shiftright("slot", BLOCK_BITS)).applyInPandas(fold, "plane int, block int, bits binary")
    planes = np.zeros((-(-len(languages) // 8), 1 << bits), np.uint8)
    for r in blocks.collect():
        planes[r["plane"], r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["bits"], np.uint8)
    full = [float(((planes[i // 8] >> (i % 8)) & 1).mean()) ** len(HASHES) for i in range(len(languages))]
    return Model(languages, planes, full, bits, gram)


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.float64)


def predict_one(text: str | None, model: Model) -> tuple[str, float]:
    if not has_letter(text):
        return "und", 0.0
    seen = np.zeros(len(model.planes) * 8)
    n = 0
    for values in grams(text, model.gram):
        at = slots(values, model.slot_bits)
        n += len(values)
        for k, plane in enumerate(model.planes):
            hit = plane[at[0]]
            for s in at[1:]:
                hit &= plane[s]
            seen[8 * k : 8 * k + 8] += np.bincount(hit, minlength=256) @ _ONES
    rates = np.array(model.false_rate)
    true = np.clip((seen[: len(model.languages)] / max(1, n) - rates) / np.maximum(1e-9, 1 - rates), 0, None)
    if not true.sum():
        return model.languages[0], 1.0 / len(model.languages)
    best = int(true.argmax())
    return model.languages[best], float(true[best] / true.sum())


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return own.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_one(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
