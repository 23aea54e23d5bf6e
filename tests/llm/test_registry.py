"""Registered operators against their DuckDB twins, the pipeline against a plain version."""

import collections
import re

import pytest

import corpus_pipeline
from plumbline.llm import mixing, registry

from ..oracle import DATA, both


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert ours == theirs


def grams(text):
    w = re.findall(mixing.WORD, (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pipeline_stages(spark, tmp_path):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = rows
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = kept, spark.read.parquet(str(tmp_path / name))
        kept = {r.doc_id: r for r in docs.collect()}
        assert set(kept) <= set(before)
        if name != "token_files":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "ngram_join":
            sets = {i: grams(r.text) for i, r in before.items()}
            near = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            root = {i: i for i in sets}
            for _ in sets:
                for a, b in near:
                    root[a] = root[b] = min(root[a], root[b])
            assert set(kept) == {i for i in sets if root[i] == i}
        if name in ("toxicity", "ngram_join", "decontaminate"):
            assert all(kept[i] == before[i] for i in kept)
        if name == "mixing":
            words = collections.Counter()
            for r in kept.values():
                words[r.source] += len(re.findall(mixing.WORD, r.text))
            assert words and all(n <= 3 * sum(len(re.findall(mixing.WORD, x.text or "")) for x in before.values() if x.source == s) for s, n in words.items())
    tokens = sorted(kept.values(), key=lambda r: r.doc_id)
    assert [r.start for r in tokens] == [sum(x.n_tokens for x in tokens[:k]) for k in range(len(tokens))]


ODD = "doc_id long, text string, lang string, source string, n_chars long, component long, toxicity double, key string, c1 long, rn int, part string"


def odd(spark, rows):
    """Documents with columns whose names the stages use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 0.5, "k", 2, 3, "p") for i, t, s in rows], ODD)


def words_of(n, k):
    return " ".join(f"w{k}x{j}" for j in range(n))


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, int(k % 2)) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, words_of(30, 70)), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def run_stage(spark, name, rows, folder):
    docs = odd(spark, rows)
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def test_stages_on_empty_tables(spark, odd_tables):
    for name, _ in corpus_pipeline.STAGES:
        out = run_stage(spark, name, [], odd_tables)
        assert out.count() == 0
        assert name == "token_files" or out.columns == list(corpus_pipeline.COLUMNS)


def test_near_duplicate_stage_keeps_what_is_no_copy(spark, odd_tables):
    a, b = words_of(60, 1), words_of(60, 2)
    rows = [(1, a, "s"), (2, a + " tail", "s"), (2, b, "s"), (3, None, "s"), (4, "", None), (None, a, "s"), (None, a, "s"), (5, words_of(9000, 3), "s"), (6, b, "s"), (6, b, "s")]
    out = run_stage(spark, "ngram_join", rows, odd_tables)
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    # of a's class the row of the repeated id stays; of b's one row
    assert kept[2, a + " tail"] == 1 and (1, a) not in kept
    assert kept[2, b] + kept[6, b] == 1
    assert kept[None, a] == 2 and kept[3, None] == kept[4, ""] == 1 and kept[5, rows[7][1]] == 1
    assert sum(kept.values()) == 7


def test_toxicity_stage(spark, odd_tables):
    rows = [(k, words_of(30, k) + (" vilething" if k % 2 else ""), "s") for k in range(60)] + [(None, "vilething here", "s"), (100, None, "s"), (101, "", "s"), (7, words_of(30, 7), "s"), (102, "vilething " * 3000, "s")]
    kept = collections.Counter((r.doc_id, r.text) for r in run_stage(spark, "toxicity", rows, odd_tables).collect())
    assert kept == collections.Counter((i, t) for i, t, _ in rows if "vilething" not in (t or ""))


def test_decontaminate_stage(spark, odd_tables):
    item = words_of(30, 70)
    rows = [(1, f"before {item} after", "s"), (2, words_of(50, 4), "s"), (2, item, "s"), (3, None, "s"), (None, item, "s"), (4, words_of(5000, 5) + " " + item.upper(), "s"), (5, words_of(12, 70), "s"), (6, "", "s")]
    kept = collections.Counter((r.doc_id, r.text) for r in run_stage(spark, "decontaminate", rows, odd_tables).collect())
    assert kept == collections.Counter((i, t) for i, t, _ in rows if i in (3, 5, 6) or (i, t) == (2, rows[1][1]))


def test_mixing_and_token_stages(spark, odd_tables):
    from tokenizers import Tokenizer

    from plumbline.llm import token_files

    rows = [(k, words_of(20 + k, k), "ab"[k % 2]) for k in range(40)] + [(None, words_of(30, 90), "a"), (None, words_of(31, 91), None), (50, None, "a"), (51, "", "b"), (5, words_of(25, 5), "b"), (5, words_of(25, 5), "b")]
    out = run_stage(spark, "mixing", rows, odd_tables).collect()
    whole = collections.defaultdict(set)
    for i, t, _ in rows:
        whole[i] |= set((t or "").split())
    assert out and all(set(r.text.split()) <= whole[r.doc_id] and r.n_chars == len(r.text) for r in out)
    tokens = run_stage(spark, "token_files", rows, odd_tables).collect()
    tokenizer = Tokenizer.from_file(token_files.default_path())
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sorted(r.n_tokens for r in tokens) == want
