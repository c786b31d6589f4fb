"""Operators 11 to 13: the registered queries and the operators against brute-force versions, and their defined results on odd input."""
import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from claimlens.llm import catalog, runs, token_alignment, url_rules

FILE_A, FILE_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PERIODIC = " ".join(["tick tock tack"] * 40)
TEXTS = [None, "", " \t\n", "a", "  two  spaces ", "line\n\n next\n  more\t tab", "x\u00a0 y \u2003 z \u3000 q", "日本語 テキスト 🙂🙂", "<|endoftext|> <s> </s> <unk>",
         "▁ under ▁", "plain ▁ words here", "a\x00b \x1c c", "ÄÖÜ straße naïve café", "  " * 50 + "x", "\n \n \n a", "x" * 3000, "don't we'll 1234567 3.14", PERIODIC,
         "head " + PERIODIC + " tail", PERIODIC, "a " * 24, "a " * 23, " ".join(f"w{i}" for i in range(30_000)), "ab " * 20_000]


def table(spark, rows):
    """Documents with extra columns whose names clash with working ones."""
    return spark.createDataFrame([(i, t, 5, "k", 7, "en") for i, t in rows], "doc_id long, text string, n_a long, block string, total long, pairs string")


ODD = [*enumerate(TEXTS), (3, "same id again"), (3, "same id again"), (None, PERIODIC), (None, None)]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# 11 -------------------------------------------------------------------------------------------------

def brute_alignment(rows):
    """Whole texts encoded at once; two tokens are linked if some byte belongs to both."""
    known = token_alignment.aligner(FILE_A, FILE_B)
    counts, found = Counter(), []
    for doc_id, text in rows:
        a = known.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = known.b.encode(text) if text else []
        bytes_a, bytes_b = [known.bytes_a[x] for x in a], [known.bytes_b[x] for x in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((doc_id, [], [], 0, [], ""))
            continue
        of_a = np.repeat(np.arange(len(a)), [len(x) for x in bytes_a]).tolist()
        of_b = np.repeat(np.arange(len(b)), [len(x) for x in bytes_b]).tolist()
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        told, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x_to, y_to = bisect_left(ends_a, end) + 1, bisect_left(ends_b, end) + 1
            told.append(",".join(map(str, a[x:x_to])) + "|" + ",".join(map(str, b[y:y_to])))
            x, y = x_to, y_to
        links = [(a[i], b[j]) for i, j in set(zip(of_a, of_b))]
        counts.update(links)
        found.append((doc_id, a, b, len(told), links, hashlib.sha256(";".join(told).encode()).hexdigest()))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(i, len(a), len(b), groups, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), told)
            for i, a, b, groups, links, told in found]


@pytest.mark.parametrize("block_chars", [500, 1 << 22])
def test_alignment_of_odd_texts(spark, block_chars):
    same(token_alignment.align_texts(table(spark, ODD).repartition(3), FILE_A, FILE_B, block_chars).collect(), brute_alignment(ODD))


def test_alignment_query(spark, sf, documents):
    got = catalog.queries()["op11_end_intersection"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(got.collect(), brute_alignment(documents))


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align_texts(table(spark, []), FILE_A, FILE_B).count() == 0


def test_groups_and_links_by_hand():
    a_to, b_to, link_a, link_b = token_alignment.aligned(np.array([2, 5, 9]), np.array([1, 3, 5, 9]))
    assert (a_to.tolist(), b_to.tolist()) == ([2, 3], [3, 4])
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)]


def test_forgotten_pieces_are_encoded_anew():
    known = token_alignment.PairAligner(FILE_A, FILE_B, pool_chars=300)
    kept = token_alignment.aligner(FILE_A, FILE_B)
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 9) + rng.choice(["", "é", "x1"]) for _ in range(20)) for _ in range(3)]
        assert token_alignment._block(known, [1, 2, 3], texts)[2:5] == token_alignment._block(kept, [1, 2, 3], texts)[2:5]
    assert known.chars < 1000


# 12 -------------------------------------------------------------------------------------------------

RULE_SCHEMA = "verdict string, host string, path string"
HOSTS = ["net", "example.net", "a.example.net", "b.a.example.net", "notexample.net", "example.com", "org", "x.org", "A.Org", "", "com", "a..net", ".net", "net.", "net:80"]
PATHS = ["", "/", "/en", "/en/", "/en/1", "/de/2?x", "/fr/#a", "?/en/", "/e", "/en/1/2", "/é", "/\U0010ffff", "/en/\U0010ffff\U0010ffff", "/en/" + "x" * 50_000]
URLS = [None, "", "no scheme", "://", "http://", "x://net/y://org/fr/", *(f"http://{h}{p}" for h in HOSTS for p in PATHS)] * 2


def lower(host):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = lower(host)
    fits = [(len(h) + len(p), len(h), v, lower(h) + p) for v, h, p in rules
            if h and p is not None and (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def random_rules(n):
    rng = random.Random(3)
    return [(rng.choice(["block", "allow"]), rng.choice(HOSTS[:-1]), "".join(rng.choice(["/", "/e", "n", "/en/", "1", ""]) for _ in range(rng.randint(0, 3)))) for _ in range(n)]


@pytest.mark.parametrize("rules", [list(catalog.URL_RULES), [*random_rules(120), ("block", None, "/"), ("block", "net", None)], []])
def test_urls_against_every_rule(spark, rules):
    rows = [(i if i % 7 else None, u, "x", 1) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, slice string, step int").repartition(4)
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA)).collect()
    same(got, [(i, *brute_verdict(u, rules)) for i, u, *_ in rows])


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(pages, spark.createDataFrame(list(catalog.URL_RULES), RULE_SCHEMA)).count() == 0


def test_url_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    got = catalog.queries()["op12_url_intervals"](spark, sf)
    rel = con.execute(catalog.oracle_sql()["op12_url_intervals"])
    assert [d[0] for d in rel.description] == got.columns
    same(got.collect(), rel.fetchall())


# 13 -------------------------------------------------------------------------------------------------

def brute_runs(ids):
    """Every stretch that keeps some period, as far as it reaches; those of 24 words and three smallest periods."""
    found = []
    for q in range(1, len(ids) // 3 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted((r for r in found if not any(all(ids[k] == ids[k + d] for k in range(r[0], r[0] + r[1] - d)) for d in range(1, r[2]))),
                  key=lambda r: (r[0], r[2]))


def brute_document(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_runs_of_random_sequences():
    rng = np.random.default_rng(1)
    total = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 5)):
            base = rng.integers(0, rng.integers(1, 4), rng.integers(1, 14))
            parts += [np.tile(base, rng.integers(1, 12))[:rng.integers(1, 150)], rng.integers(0, rng.integers(1, 3) + 1, rng.integers(0, 10))]
        ids = np.concatenate(parts)
        want = brute_runs(ids.tolist())
        total += len(want)
        assert runs.find_runs(ids) == want
    assert total > 300


def test_runs_of_odd_texts(spark):
    short = [(i, t) for i, t in ODD if t is None or len(t) < 50_000]
    same(runs.periodic_runs(table(spark, short)).collect(), [brute_document(i, t) for i, t in short])
    assert runs.periodic_runs(table(spark, [])).count() == 0


def test_runs_of_long_texts():
    assert runs.find_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert runs.find_runs(np.arange(60_000)) == []
    assert runs.find_runs(np.arange(60_000) % 9_000) == [(0, 60_000, 9_000)]


def test_runs_query(spark, sf, documents):
    got = catalog.queries()["op13_periodic_runs"](spark, sf).collect()
    short = {i for i, t in documents if len((t or "").split()) < 1500}
    same([r for r in got if r["doc_id"] in short], [brute_document(i, t) for i, t in documents if i in short])
    assert len(got) == len(documents) and sum(r["n_runs"] > 0 for r in got) > 5


def test_a_blocks_pieces_are_looked_up_some_at_a_time(monkeypatch):
    texts = ["one two  three", None, "", "four\u2581five six", "one two", " seven"] * 3
    ids = list(range(len(texts)))
    want = token_alignment._block(token_alignment.PairAligner(FILE_A, FILE_B), ids, texts)
    known, most = token_alignment.PairAligner(FILE_A, FILE_B), []
    numbers = known.numbers
    monkeypatch.setattr(known, "numbers", lambda pieces: most.append(len(pieces)) or numbers(pieces))
    monkeypatch.setattr(token_alignment, "_stretches", lambda texts, whole=token_alignment._stretches: whole(texts, 10))
    got = token_alignment._block(known, ids, texts)
    assert max(most) <= 4 < sum(most)
    assert [got[1], got[2], got[3], got[4]] == [want[1], want[2], want[3], want[4]]  # texts, ids, figures and hashes
    assert dict(zip(got[10].tolist(), got[11].tolist())) == dict(zip(want[10].tolist(), want[11].tolist()))


def test_second_pass_holds_one_block_and_no_pool(monkeypatch):
    """Of a batch of blocks one row at a time is made Python's, and what the worker kept of the first pass is let go."""
    def block(i):
        known = token_alignment.PairAligner(FILE_A, FILE_B)
        row = dict(zip([f.split(" ")[0] for f in token_alignment.BLOCK.split(", ")], token_alignment._block(known, [i], [f"some words {i}"])))
        n = len(row.pop("pairs"))
        del row["links"]
        return {**row, "total": [1] * n, "best": [True] * n}

    monkeypatch.setattr(token_alignment, "_aligners", {("a", "b"): None})
    got = token_alignment._summed(iter([pa.RecordBatch.from_pylist([block(1), block(2)])]))
    first = next(got)
    assert not token_alignment._aligners
    ids = first.column(0).to_pylist() + [i for b in got for i in b.column(0).to_pylist()]
    assert first.num_rows == 1 and ids == [1, 2]


def test_second_pass_deals_its_blocks_to_as_many_parts(spark):
    """All rows of a task may go into one Arrow batch, so blocks of megabytes are not put together."""
    rows = [(i, f"some words {i}") for i in range(60)]
    got = token_alignment.align_texts(table(spark, rows).coalesce(1), FILE_A, FILE_B, block_chars=50)
    assert got.rdd.getNumPartitions() >= 10
    same(got.collect(), brute_alignment(rows))


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    """A file holds ``FILE_BLOCKS`` rows of megabytes at most, whatever the size of the task that writes it."""
    kept, whole = [], token_alignment.staged
    monkeypatch.setattr(token_alignment, "staged", lambda *x: kept.append(whole(*x)) or kept[-1])
    rows = [(i, f"some words {i}") for i in range(60)]
    token_alignment.align_texts(table(spark, rows).coalesce(1), FILE_A, FILE_B, block_chars=50)
    assert max(r["count"] for r in kept[0].groupBy(F.input_file_name()).count().collect()) <= token_alignment.FILE_BLOCKS
