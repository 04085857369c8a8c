"""Language of documents: known words by their frequency in each language, unseen words by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, stored
from .toxicity import held_out

c = F.col
#: Words: runs of letters; longer runs are several words.
LONGEST = 64
LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
#: Longest n-gram that an unseen word falls back to; words have a space at both ends.
LONGEST_GRAM = 5
#: Bounds of the sample that the classifier is fitted on: languages (the most frequent ones), texts and characters in all.
LANGUAGES, SAMPLE_TEXTS, SAMPLE_CHARS = 256, 8_000, 24_000_000
#: Added to each count, so that no language is ruled out by one word.
SMOOTHING = 0.5
#: Characters of a text that are split into words at a time, and unseen words whose scores a task remembers.
PIECE, REMEMBERED = 1 << 20, 200_000


def pieces(text: str) -> Iterator[str]:
    """The text cut between words, about PIECE characters each."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        run = LETTERS.match(text, end)
        end = run.end() if run else end
        yield text[at:end]
        at = end
    yield text[at:]


def words(text: str) -> Counter:
    found: Counter = Counter()
    for p in pieces(text):
        found.update(LETTERS.findall(p.lower()))
    return found if any(x.isalpha() for w in found for x in w) else Counter()


def grams(word: str, n: int) -> list[str]:
    spaced = f" {word} "
    return [g for i in range(len(spaced) - n + 1) if (g := spaced[i : i + n]) != " "]


@dataclass
class Model:
    """Log frequencies: a row for each word and n-gram, a column for each language."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """The mean of the longest n-grams of the word that the model knows; all zero if it knows none of its characters."""
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            if known := [k for g in grams(word, n) if (k := self.grams.get(g)) is not None]:
                return np.add.reduce(self.gram_logs[known], 0) / len(known)
        return np.zeros(len(self.languages))

    def posterior(self, found: Counter, memory: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of each language; words in order, so that equal texts have equal scores wherever they are computed."""
        total, rows, times = self.prior.copy(), [], []
        for w in sorted(found):
            if (k := self.words.get(w)) is not None:
                rows.append(k)
                times.append(found[w])
            else:
                if (logs := memory.get(w)) is None:
                    logs = self.unseen(w)
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[w] = logs
                total += found[w] * logs
        if rows:
            total += np.add.reduce(self.word_logs[rows] * np.array(times, float)[:, None], 0)
        p = np.exp(total - total.max())
        return p / p.sum()


def _logs(counts: dict[str, dict[int, int]], n: int) -> tuple[dict[str, int], np.ndarray]:
    names = sorted(counts)
    table = np.zeros((len(names), n))
    for i, w in enumerate(names):
        for k, times in counts[w].items():
            table[i, k] = times
    table += SMOOTHING
    return {w: i for i, w in enumerate(names)}, np.log(table / table.sum(0)) if len(names) else table


def sample(docs: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """Languages to learn, their share of all labelled texts, and (lang, text) of the sample, copies once.

    The shares are counts over all rows. Texts are taken in the order of their hashes, an equal number and as many characters for
    each language; a text that doesn't fit any more is passed over, and none is cut.
    """
    labelled = docs.where(~held_out() & c("lang").isNotNull() & c("text").isNotNull()).select("lang", "text")
    light = stored(labelled.select("lang", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n")), "labelled")
    stats = light.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h", 0.02).alias("texts")).orderBy(c("rows").desc(), "lang").limit(LANGUAGES).collect()
    if not stats:
        return [], np.zeros(0), labelled.limit(0)
    stats.sort(key=lambda r: r["lang"])
    share = SAMPLE_TEXTS // len(stats), SAMPLE_CHARS // len(stats)
    # Hashes are spread evenly, so that a bound on them leaves about twice the texts that are wanted.
    below = F.create_map(*[x for r in stats for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * share[0] / r["texts"])))])
    u = F.pmod(c("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = light.where((c("n") <= share[1]) & (u < F.coalesce(below[c("lang")], F.lit(0.0)))).groupBy("lang", "h").agg(F.max("n").alias("n"))
    left = {r["lang"]: list(share) for r in stats}
    chosen = []
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["h"] % (1 << 40), r["h"])):
        room = left[r["lang"]]
        if room[0] > 0 and r["n"] <= room[1]:
            room[0], room[1] = room[0] - 1, room[1] - r["n"]
            chosen.append((r["lang"], r["h"]))
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h long"))
    texts = labelled.withColumn("h", F.xxhash64("text")).join(picked, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")
    rows = np.array([r["rows"] for r in stats], float)
    return [r["lang"] for r in stats], rows / rows.sum(), texts


def fit(docs: DataFrame) -> Model | None:
    """None if no row has a language to learn from. Counts come from Spark; their number is bounded by the sample's characters."""
    languages, shares, texts = sample(docs)
    if not languages:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, w, n) for lang, ws in found.items() for w, n in ws.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])

    counts = texts.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = {lang: k for k, lang in enumerate(languages)}
    by_word: dict[str, dict[int, int]] = {}
    by_gram: dict[str, dict[int, int]] = {}
    for r in counts.toLocalIterator():
        k = place[r["lang"]]
        by_word.setdefault(r["word"], {})[k] = r["n"]
        for n in range(1, LONGEST_GRAM + 1):
            for g in grams(r["word"], n):
                at = by_gram.setdefault(g, {})
                at[k] = at.get(k, 0) + r["n"]
    if not by_word:
        return None
    known, word_logs = _logs(by_word, len(languages))
    parts, gram_logs = _logs(by_gram, len(languages))
    return Model(languages, np.log(shares), known, word_logs, parts, gram_logs)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row. Without a model, or where a text is null or has no letter, `und` and 0."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, c("text").alias("__text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = sent.value, {}
        for b in chunks(batches):
            langs, scores = [], []
            for text in b.column("__text").to_pylist():
                found = words(text) if text and m else None
                if found:
                    p = m.posterior(found, memory)
                    k = int(p.argmax())
                    langs.append(m.languages[k])
                    scores.append(float(p[k]))
                else:
                    langs.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return rows.mapInArrow(scored, f"{kept}, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only rows that aren't held out and have a language teach.

    A word that the sample knows counts with its log frequency in each language; any other with the mean log frequency of its
    longest known n-grams, from five characters down to one. The score is the posterior of the language that wins, of equal ones the
    first by code point. Null and letterless texts, and all texts if no row has a language, are `und` with score 0. A null doc_id
    counts as the empty text, so it is held out. Repeated rows each have a row; copies teach once.
    """
    rows = docs.withColumn("__held", held_out()).select("doc_id", c("__held").alias("held_out"), "text")
    return predict(rows, fit(docs), ["doc_id", "held_out"])


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))
