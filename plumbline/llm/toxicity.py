"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded before matching: lower case, compatibility forms, homoglyphs
of other scripts, digits and signs that stand for letters; everything else
becomes a space.  The lexicon is learned from labelled rows: whole words and
word stems (a stem must open several words) whose share among toxic documents
exceeds that among clean ones, weighted by their log odds ratio.  Exceptions are
words that open with a stem but prevail in clean documents, phrases of two or
three words around a hit that prevail there, and phrases given as a parameter:
a hit inside one does not count.  The score is a logistic function of the
weights found, normalised by the text's length.

The labelled rows are a bounded sample (``max_train``) and the model is of
bounded size (``max_entries`` of the heaviest entries and of the commonest
exceptions of each sort); everything else covers all rows in one pass without
a shuffle of texts.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import frugal, materialise

#: Letters of other scripts that look Latin, and digits read as letters.
#: l, i and 1 fold to one letter, as the digit may stand for either.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
STEM_LENGTHS = (3, 4, 5, 6, 7, 8, 9)
TERMS = "term string, kind int, pos long, neg long"


class _Folding(dict):
    """Translation table that decides a character when it first meets it."""

    def __missing__(self, code: int):
        char = chr(code)
        to = LOOKALIKES.get(char, char)
        to = DIGITS.get(to, to) if to.isalnum() else " "
        self[code] = to
        return to


_FOLDING = _Folding()
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")


def fold(text: str) -> str:
    """Folded words with a space before, between and after them.

    A word of digits alone is folded like others; it can match no lexicon entry
    that was learned from words with letters unless it spells one.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(_FOLDING)} "


@dataclass(frozen=True)
class ToxicityParams:
    """max_train: bound of the labelled rows used; min_share: least share of the
    toxic documents that a lexicon entry is in; min_docs: and least number;
    min_weight: least log odds ratio; min_evidence: least log likelihood ratio of
    an entry against one shared share of toxic documents (10 is a chance of about
    1 in 100,000), which keeps rare words of a small sample out; stem_words: words that a stem opens;
    max_entries: bound of the lexicon; phrases: more exception phrases; threshold:
    least score of a toxic document."""

    max_train: int = 30_000
    min_share: float = 0.01
    min_docs: int = 3
    min_weight: float = 3.0
    min_evidence: float = 10.0
    stem_words: int = 4
    max_entries: int = 5_000
    phrases: tuple[str, ...] = ()
    threshold: float = 0.7
    prior: float = 0.5


@dataclass
class Lexicon:
    """words and stems with weights, exception words and phrases, and the score's slopes and offset."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = -20.0

    def automaton(self):
        """Aho-Corasick automaton over folded text; payload (length, weight), weight 0 for an exception."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, w in self.stems.items():
            found.add_word(f" {stem}", (len(stem) + 1, w))
        for word, w in self.words.items():
            found.add_word(f" {word} ", (len(word) + 2, w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(found):
            found.make_automaton()
        return found


def _hits(folded: str, automaton) -> dict[int, float]:
    """Weight of the heaviest entry that starts at each place, those inside an exception left out."""
    hits, safe = {}, []
    for end, (size, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end - size + 1
        if weight:
            hits[start] = max(weight, hits.get(start, 0.0))
        else:
            safe.append((start, end))
    if safe and hits:
        safe.sort()
        starts, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))
        covered = ((at, bisect.bisect_right(starts, at)) for at in hits)
        hits = {at: hits[at] for at, k in covered if not k or reach[k - 1] <= at}
    return hits


def features(text: str, automaton) -> tuple[float, float]:
    """Logs of 1 + the weight of hits outside exceptions per 100 words, and of 1 + their number."""
    folded = fold(text)
    hits = _hits(folded, automaton)
    if not hits:
        return 0.0, 0.0
    return math.log1p(100 * sum(hits.values()) / (len(folded.split()) + 10)), math.log1p(len(hits))


def _counted(texts: Iterator[tuple[str, int]], terms_of, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(term, kind, pos, neg): documents by label that hold a term, added up until some ``most`` characters of terms are held."""
    counts, held = {}, 0

    def flush():
        keys = sorted(counts)
        made = {"term": pa.array([k[0] for k in keys], pa.string()), "kind": pa.array([k[1] for k in keys], pa.int32())}
        made |= {name: pa.array([counts[k][y] for k in keys], pa.int64()) for y, name in ((1, "pos"), (0, "neg"))}
        counts.clear()
        return pa.RecordBatch.from_pydict(made)

    for text, toxic in texts:
        for key in terms_of(text):
            if key not in counts:
                counts[key] = [0, 0]
                held += len(key[0]) + 64
            counts[key][toxic] += 1
        if held > most:
            held = 0
            yield flush()
    if counts:
        yield flush()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            yield text.as_py() or "", toxic.as_py()


def _words_and_stems(text: str) -> set[tuple[str, int]]:
    words = set(fold(text).split())
    return {(w, 0) for w in words} | {(w[:k], 1) for w in words for k in STEM_LENGTHS if len(w) > k}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts by label of words (kind 0) and word stems (kind 1)."""
    yield from _counted(_labelled(batches), _words_and_stems)


def _contexts(lexicon: Lexicon):
    """Document counts by label of the phrases of two and three words around a hit (kind 1), and of any hit (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()

        def phrases(text: str) -> set[tuple[str, int]]:
            folded, found = fold(text), set()
            for at in _hits(folded, automaton):
                before, after = folded[max(0, at - 80) : at].split()[-1:], folded[at : at + 240].split()[:2]
                found |= {" ".join(x) for x in (before + after[:1], after, before + after) if len(x) > 1}
            return {(x, 1) for x in found} | {("", 0) for _ in found}

        yield from _counted(_labelled(batches), phrases)

    return run


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([features(t or "", automaton) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"x": pa.array(x[:, 0]), "k": pa.array(x[:, 1]), "toxic": batch.column("toxic")})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[tuple[float, float], float]:
    """Slopes (not below 0) and offset of a two-feature logistic regression, classes of equal weight, by Newton steps."""
    if not len(y) or y.min() == y.max():
        return (0.0, 0.0), -20.0
    design = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    free = [0, 1, 2]
    while True:
        part, beta = design[:, free], np.zeros(len(free))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ beta, -30, 30)))
            gradient = part.T @ (weight * (y - p)) - ridge * beta
            hessian = (part * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ part + ridge * np.eye(len(free))
            step = np.linalg.solve(hessian, gradient)
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        whole = np.zeros(3)
        whole[free] = beta
        if (whole[:2] >= 0).all():
            return (float(whole[0]), float(whole[1])), float(whole[2])
        free = [k for k in free if k == 2 or whole[k] > 0]


def _evidence(pos: int, neg: int) -> Column:
    """Log likelihood ratio of a term's own share of toxic documents against that of ``pos`` toxic and ``neg`` clean ones."""
    seen = F.col("pos") + F.col("neg")
    return sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (seen * F.lit(n / (pos + neg))))).otherwise(0.0) for c, n in (("pos", pos), ("neg", neg)))


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> Lexicon:
    """Learn the lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1).

    A label is null-safe: rows without a text count as empty, rows with a null
    label or doc_id are left out.  Without labels of both kinds the lexicon is
    empty and every score is near 0.
    """
    p = params or ToxicityParams()
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = usable.count()
    if n > p.max_train:  # a share by hash that stays below the bound; the limit only guards it, so reruns agree
        usable = usable.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.95 * p.max_train / n)).limit(p.max_train)
    # at most max_train rows of a number and a label: a broadcast of proven size
    sample = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")
    sample = materialise(sample.dropDuplicates(["text", "toxic"]), "toxic-sample")
    totals = {int(y): c for y, c in sample.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon()
    terms = materialise(
        sample.mapInArrow(frugal(_terms), TERMS).groupBy("term", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")),
        "toxic-terms",
    )
    weight = F.log((F.col("pos") + p.prior) / (pos + 1)) - F.log((F.col("neg") + p.prior) / (neg + 1))
    least = max(p.min_docs, math.ceil(p.min_share * pos))
    cleaner = F.col("neg") / neg > F.col("pos") / pos
    strong = terms.withColumn("w", weight).filter((F.col("pos") >= least) & (F.col("w") >= p.min_weight) & (_evidence(pos, neg) >= p.min_evidence))
    entries = strong.orderBy(F.desc("w"), "term").limit(p.max_entries).collect()
    stems = _stems(terms, {r.term: (r.pos, r.w) for r in entries if r.kind == 1}, p)
    words = {r.term: r.w for r in entries if r.kind == 0 and not any(r.term.startswith(s) for s in stems)}
    safe: list[str] = []
    if stems:
        opened = F.lit(False)
        for stem in stems:
            opened = opened | F.col("term").startswith(stem)
        clean = terms.filter((F.col("kind") == 0) & opened & cleaner)
        safe = [r.term for r in clean.orderBy(F.desc("neg"), "term").limit(p.max_entries).collect()]
    lexicon = Lexicon(words, stems, tuple(safe) + tuple(" ".join(fold(x).split()) for x in p.phrases))
    around = sample.mapInArrow(frugal(_contexts(lexicon)), TERMS).groupBy("term", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    around = materialise(around, "toxic-phrases")
    hit = around.filter("kind = 0").first()
    if hit and hit.pos and hit.neg:  # a phrase must be cleaner than hits are as a rule, beyond chance
        clean = around.filter((F.col("kind") == 1) & (F.col("neg") >= p.min_docs) & cleaner & (_evidence(hit.pos, hit.neg) >= p.min_evidence))
        lexicon.exceptions += tuple(r.term for r in clean.orderBy(F.desc("neg"), "term").limit(p.max_entries).collect())
    rows = np.array([tuple(r) for r in sample.mapInArrow(_measured(lexicon), "x double, k double, toxic int").collect()])
    lexicon.slopes, lexicon.offset = fit_logistic(rows[:, :2], rows[:, 2])
    return lexicon


def _stems(terms: DataFrame, strong: dict[str, tuple[int, float]], p: ToxicityParams) -> dict[str, float]:
    """Strong stems that open enough words; none opens another."""
    if not strong:
        return {}
    stem = F.explode(F.array(*[F.substring("term", 1, k) for k in STEM_LENGTHS])).alias("stem")
    opened = terms.filter("kind = 0 AND pos > 0").select("term", stem).filter(F.col("stem").isin(list(strong)) & (F.col("stem") != F.col("term")))
    many = {r.stem for r in opened.distinct().groupBy("stem").count().filter(F.col("count") >= p.stem_words).collect()}
    kept: dict[str, float] = {}
    # purest and widest first; of nested stems with equal figures the longest
    for s in sorted(many, key=lambda s: (-strong[s][1], -len(s), s)):
        if not any(s.startswith(t) or t.startswith(s) for t in kept):
            kept[s] = strong[s][1]
    return kept


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1) appended; null and empty texts get the score of no hits."""
    fields = [f for f in docs.schema.fields if f.name != "toxicity"]
    names = [f.name for f in fields]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([features(t or "", automaton) for t in batch.column(at).to_pylist()], np.float64).reshape(-1, 2)
            z = x @ np.array(lexicon.slopes) + lexicon.offset
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*names, "toxicity"])

    schema = docs.select(*names).schema.add("toxicity", "double")
    return docs.select(*names).mapInArrow(frugal(run), schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text leaves another remainder than 1 by 3."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, lexicon).select(
        "doc_id",
        held.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= ToxicityParams().threshold).cast("int").alias("predicted"),
    )
