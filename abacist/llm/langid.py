"""Language identification by bit-sliced Bloom filters over n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.llm.common import mix, raw, slices, with_text, written

#: n-grams of so many bytes of lower-cased text, in which all but letters is one blank.
SIZES = (3, 4)
#: Documents of one language that training reads, on average; picked by a hash of the id.
TRAIN_DOCS = 4000
#: The n-grams of one language that the filters hold: the most frequent ones of the sample.
GRAMS = 40_000
#: An n-gram belongs to each language where its share is at least this part of its highest share.
NEAR = 0.5
#: Slots of the filters, each with a bit for every language, and probes for an n-gram.
SLOTS = 1 << 20
PROBES = 2
SLICE = 1 << 19
UNKNOWN = "und"
#: Standard deviations of the false hits that do not count as covered.
MARGIN = 3

_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def plain(text: pa.Array) -> pa.Array:
    """Lower case, runs of anything but letters as one blank, a blank at both ends."""
    text = pc.fill_null(text, "")
    return pc.binary_join_element_wise("", pc.replace_substring_regex(pc.utf8_lower(text), r"[^\pL\pM]+", " "), "", " ")


def grams(data: np.ndarray, offsets: np.ndarray):
    """For every size: the n-grams that lie within a row, and how many each row has."""
    code = data.astype(np.uint64)
    lengths = np.diff(offsets)
    for n in range(2, max(SIZES) + 1):
        code = code[:-1] | (data[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1)))
        if n not in SIZES:
            continue
        inside = np.ones(len(code), bool)
        for k in range(1, n):
            bad = offsets[1:] - k
            inside[bad[(bad >= 0) & (bad < len(code))]] = False
        yield code[inside] | (np.uint64(n) << np.uint64(56)), np.maximum(lengths - n + 1, 0)


def slots(codes: np.ndarray, n: int) -> list[np.ndarray]:
    return [(mix(codes ^ seed) & np.uint64(n - 1)).astype(np.int64) for seed in _SEEDS[:PROBES]]


def _counted(batches):
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            own = batch.column(0).filter(pa.array(langs == lang))
            for i, j in slices(raw(own)[1], SLICE):
                found = [x for x, _ in grams(*raw(plain(own.slice(i, j - i))))]
                if not found:
                    continue
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


@dataclass
class LanguageFilters:
    """`masks[slot]` has bit k set if some n-gram of `languages[k]` falls in the slot."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def predict(self, docs: DataFrame, text_col: str = "text", pred: str = "lang_pred", score: str = "score", covered: str | None = None) -> DataFrame:
        """`docs` with the language and its score added, or replaced where they exist.

        Every n-gram of the whole text asks the filters once and gets a mask of
        languages.  Hits are counted for each language, less the share of false
        hits that its filter's fill makes likely; the highest count wins, ties
        go to the first language.  `score` is the winner's share of all counts.
        Null text and text without a letter give `und` and 0, and so does all
        text if nothing was learnt.  Text whose n-grams are in no filter gets
        the first language and 0.  `covered` names one more column: the part of
        the text's n-grams that the winner's filter knows, less MARGIN standard
        deviations of the false hits.  It tells foreign text; `score` does not.
        """
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((self.languages, self.masks, self.false_rate))
        added = [pred, score, *([covered] if covered else [])]
        kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in added]]
        schema = docs.select(*[f"`{c}`" for c in kept]).schema.add(pred, "string")
        for name in added[1:]:
            schema = schema.add(name, "double")
        rows, place = with_text(docs, kept, text_col)

        def run(batches):
            languages, masks, false_rate = shared.value
            for batch in batches:
                # Few rows at a time: a batch of long texts would be held in several forms at once.
                for i, j in slices(raw(batch.column(place))[1]):
                    columns = [c.slice(i, j - i) for c in batch.columns]
                    found, *numbers = judge(columns[place], languages, masks, false_rate)
                    yield pa.RecordBatch.from_arrays([*columns[: len(kept)], pa.array(found, pa.string()), *[pa.array(x, pa.float64()) for x in numbers[: len(added) - 1]]], names=[*kept, *added])

        return rows.mapInArrow(run, schema)


def judge(text: pa.Array, languages: list[str], masks: np.ndarray, false_rate: np.ndarray):
    n, k = len(text), len(languages)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    clean = plain(text)
    data, offsets = raw(clean)
    hits, total = np.zeros((n, k)), np.zeros(n)
    for i, j in slices(offsets, SLICE):
        at = offsets[i : j + 1] - offsets[i]
        for codes, counts in grams(data[offsets[i] : offsets[j]], at):
            a, *rest = slots(codes, len(masks))
            found = masks[a]
            for b in rest:
                found &= masks[b]
            ends = np.concatenate([[0], np.cumsum(counts)])
            total[i:j] += counts
            for lang in range(k):
                bits = (found[:, lang >> 6] >> np.uint64(lang & 63)) & np.uint64(1)
                sums = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
                hits[i:j, lang] += sums[ends[1:]] - sums[ends[:-1]]
    true = np.clip((hits - total[:, None] * false_rate) / (1 - false_rate), 0, None)
    best = true.argmax(axis=1)
    sums = true.sum(axis=1)
    score = np.where(sums > 0, true[np.arange(n), best] / np.where(sums > 0, sums, 1), 0.0)
    rate = false_rate[best]
    covered = np.clip(true[np.arange(n), best] - MARGIN * np.sqrt(total * rate * (1 - rate)) / (1 - rate), 0, None) / np.maximum(total, 1)
    # Marks alone are no letters.
    empty = ~np.asarray(pc.match_substring_regex(clean, r"\pL").to_numpy(zero_copy_only=False), bool)
    return [UNKNOWN if e else languages[b] for e, b in zip(empty, best)], np.where(empty, 0.0, score), np.where(empty, 0.0, covered)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageFilters:
    """Filters learnt from the rows that have text and a language.

    Of each language about TRAIN_DOCS rows are read, picked by a hash; the
    n-grams of the sample are counted by Spark, and the GRAMS most frequent of
    each language come to the driver.  Without such rows the filters are empty.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("train")).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    known = [r for r in rows.groupBy("lang").count().orderBy("lang").collect()]
    if not known:
        return LanguageFilters([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    part = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], float(min(1.0, TRAIN_DOCS / r["count"])))])
    sample = rows.filter(F.pmod("h", F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000).select("text", "lang")
    counts = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilters([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, 1.0 / totals[lang])])
    shares = counts.withColumn("share", F.col("n") * share[F.col("lang")])
    frequent = shares.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("at") <= GRAMS)
    top = frequent.select("gram").distinct().join(shares, "gram")
    high = top.withColumn("high", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= F.col("high") * NEAR)
    found = high.select("lang", "gram").toPandas()

    masks = np.zeros((SLOTS, (len(languages) + 63) // 64), np.uint64)
    false_rate = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        codes = found["gram"].to_numpy(np.int64)[(found["lang"] == lang).to_numpy()].view(np.uint64)
        bit = np.uint64(1) << np.uint64(k & 63)
        for at in slots(codes, SLOTS):
            masks[np.unique(at), k >> 6] |= bit
        false_rate[k] = (((masks[:, k >> 6] & bit) != 0).mean()) ** PROBES
    return LanguageFilters(languages, masks, false_rate)


def held_out(id_col: str = "doc_id"):
    """The part of the rows, by a checksum of the id, that training never sees."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
