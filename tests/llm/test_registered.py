"""The registered queries as returned, on the given tables: against DuckDB, the tokenizer library or a direct computation."""
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimlens.llm import catalog, decontaminate, quality
from claimlens.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
         "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def result(spark, sf):
    """Rows of a registered query."""
    return lambda name: catalog.queries()[name](spark, sf).collect()


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 0


def encoded(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_scores_beside_a_direct_base(result, texts):
    words = {i: WORD.findall(t.translate({c: c + 32 for c in range(65, 91)})) + [None] for i, t in texts.items()}
    counts = Counter(w for i, own in words.items() if not held(i, 10) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    got = result("op1_lattice_score")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        own = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 10), len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_near_duplicates_equal_their_sql(result, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.execute(catalog.oracle_sql()["op2_circulant_minhash"])
    names = [d[0] for d in rel.description]
    assert sorted(tuple(r[n] for n in names) for r in result("op2_circulant_minhash")) == sorted(rel.fetchall())


def test_quality_columns(result, texts):
    got = result("op3_nb_svm_quality")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["held_out"] == held(r["doc_id"], 5) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_token_files_equal_the_library(result, texts):
    at, want = 0, []
    for i, ids in sorted(encoded("byte_bpe_50k.json", texts).items()):
        ids = np.array([*ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result("op4_elias_fano_tokens")) == want


def test_secret_base_columns(result, texts):
    for r in result("op8_randomness_battery"):
        found = [(m.start(), n, kind, m.end()) for n, (kind, (pattern, group, least)) in enumerate(KINDS.items())
                 for m in pattern.finditer(texts[r["doc_id"]]) if len(m.group(group)) >= least]
        told = [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]
        assert [r[f"n_{kind}"] for kind in KINDS] == [sum(f[2] == kind for f in found) for kind in KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(",")) and r["spans"].split(",") == sorted(r["spans"].split(","), key=lambda s: int(s.split(":")[1]) if s else 0)


def test_token_counts_equal_the_library(result, texts):
    ids = encoded("word_bpe_49k.json", texts)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in result("op9_rank_merge_counts"))
    assert got == [(i, len(t.encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in sorted(texts.items())]


def test_search_against_all_products(spark, sf, result):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in result("op10_hnsw_search"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        products = vectors @ vectors[ids == q][0]
        order = [k for k in np.lexsort((ids, -products)) if ids[k] != q][:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        exact = dict(zip(ids.tolist(), products.tolist()))
        assert all(score == pytest.approx(exact[i], rel=1e-12) for _, i, score in found)
        hit += len({int(ids[k]) for k in order} & {f[1] for f in found})
    assert hit >= 0.9 * 20 * len(got)


def hashes(text):
    return next(W.word_chunks(pa.array([text or ""], pa.string()))).hash


def direct_leaks(rows, items, least=0.5):
    """Every item aligned with every whole text, by the plain recursion; pairs without a common run of four words left out."""
    found = {}
    for i, text in rows:
        for j, item in items:
            x, y = hashes(text), hashes(item)
            n = min(4, len(y))
            runs = [{tuple(s[k:k + n]) for k in range(len(s) - n + 1)} for s in (x.tolist(), y.tolist())]
            if not n or not runs[0] & runs[1]:
                continue
            best, row = 0, [0] * (len(x) + 1)
            for word in y:
                fresh = [0]
                for k, other in enumerate(x):
                    fresh.append(max(0, row[k] + (2 if other == word else -1), row[k + 1] - 1, fresh[k] - 1))
                best, row = max(best, *fresh), fresh
            if best >= least * 2 * len(y):
                found[i, j] = best / (2 * len(y))
    return found


def test_leaks_against_every_alignment(spark, sf, result, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = direct_leaks(texts.items(), items)
    assert want and {(r["doc_id"], r["item_id"]): r["score"] for r in result("op7_seeded_alignment")} == pytest.approx(want)


def test_edited_leaks_against_every_alignment(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rng, rows = np.random.default_rng(12), []
    for k in range(160):
        own = items[k % len(items)][1].split()
        for _ in range(int(rng.integers(0, len(own) // 3))):
            at = int(rng.integers(0, len(own)))
            own[at:at + int(rng.integers(0, 2))] = [f"e{rng.integers(10**9)}"] * int(rng.integers(0, 2))
        around = [f"n{x}" for x in rng.integers(0, 10**9, 60)]
        rows.append((k, " ".join(around[:30] + own + around[30:])))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = direct_leaks(rows, items)
    assert 100 < len(want) and {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()} == pytest.approx(want)


def test_hinge_solution_against_projected_steps():
    """The model's weights minimise the class-weighted hinge loss of the scaled indicators, as plain projected steps on the dual find them."""
    rng, size = np.random.default_rng(3), 1 << quality.BITS
    labels = (rng.random(60) < 0.6).astype(int)
    rows = [np.unique(np.concatenate([rng.integers(0, 12, 4), rng.integers(0, 8, 2) + 12 * c + 4])) for c in labels]
    held_rows = np.concatenate([np.flatnonzero(labels == c)[4::5] for c in (0, 1)])
    learn = np.setdiff1d(np.arange(60), held_rows)
    dense = np.zeros((60, 64))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    counts = [dense[[i for i in learn if labels[i] == c]].sum(0) + 1 for c in (0, 1)]
    n = [2 + (labels[learn] == c).sum() for c in (0, 1)]
    ratio = np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])
    x = dense[learn] * ratio
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = labels[learn] * 2.0 - 1
    limit = np.where(y > 0, len(learn) / (2 * (y > 0).sum()), len(learn) / (2 * (y < 0).sum()))
    z = x * y[:, None]
    gram, dual = z @ z.T, np.zeros(len(y))
    step = 1 / np.linalg.norm(gram, 2)
    for _ in range(60_000):
        dual = np.clip(dual - (gram @ dual - 1) * step, 0, limit)
    model = quality.fit(rows, labels, epochs=5000)
    assert len(model.weights) == size and np.allclose(model.weights[:64], (z.T @ dual) * ratio, atol=2e-3)
