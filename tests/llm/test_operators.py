"""Each operator against brute force, on the small tables and on odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import arrays, byte_bpe, credentials, fingerprints, near_copies, packing, quality, registry, simhash, token_files, topk, url_rules, word_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key string"
LONG = " ".join(f"word{i % 977}" for i in range(20000))
#: Null ids and texts, empty and very long texts, repeated rows, columns whose names clash with an operator's own.
ODD = [
    (1, "the cat sat on the mat", "en", "a", 22, 1.0, "x", "k"), (1, "the cat sat on the mat", "en", "a", 22, 1.0, "x", "k"), (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 1.0, "x", "k"), (None, "null id token=abcdef123", "en", "a", 23, 1.0, "x", "k"), (4, LONG, "en", "a", len(LONG), 1.0, "x", "k"),
    (5, LONG + " tail", "en", "a", None, 1.0, "x", "k"), (7, " \n\t ", "en", None, 4, 1.0, "x", "k"), (2**40, "é" * 3000 + " 漢字", "fr", "a", 3003, 1.0, "x", "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def texts(data):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet'").fetchall())


def by_sql(sql, data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return con.sql(sql).df()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_sql(spark, data, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), by_sql(registry.ORACLE_SQL[name], data)
    plain = lambda v: "-" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want) and len(got)


# -- op1 --
def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets_base_and_links(spark, odd):
    rng = random.Random(5)
    bits = ["token=", "SECRET : ", "api_key='", "apikey=", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "é漢", " ", "==", "ab", "password", '"', "login=bob "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    found = credentials.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in found.select("doc_id", credentials.listed(F.col("base")).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    near = f"login=deploy key {key} at https://db.example.net/x"
    far = f"{key} " + "word " * 100 + "login=deploy"
    spans = {r.doc_id: r.s for r in credentials.find(spark.createDataFrame([(1, near), (2, far), (3, key)], "doc_id long, text string")).select("doc_id", credentials.listed(F.col("spans")).alias("s")).collect()}
    assert [s.split(":")[0] for s in spans[1].split(",")] == ["account", "key", "endpoint"] and spans[2] == spans[3] == ""
    assert found.count() == 300 and credentials.find(odd).agg(F.sum("copies")).first()[0] == len(ODD)


def spans_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.s for r in credentials.find(df).select("doc_id", credentials.listed(F.col("spans")).alias("s")).collect()}


def test_scopes_are_gaps_between_intervals(spark):
    value = "v" * 360
    login = "login=deploy"
    found = spans_of(spark, f'secret="{value}" {login}', f'{login} secret="{value}"', f'secret="{value}" ' + "x " * 120 + login, f'secret="{"login=" * 60}"')
    assert [s.split(":")[0] for s in found[0].split(",")] == ["assign", "account"]
    assert [s.split(":")[0] for s in found[1].split(",")] == ["account", "assign"]
    assert [s.split(":")[0] for s in found[2].split(",")] == ["assign"]
    # what begins within a base span isn't told again, however far it is from the span's begin
    assert [s.split(":")[0] for s in found[3].split(",")] == ["assign"]


def test_secrets_of_a_text_with_very_many(spark):
    text = "é token=abcdef12 " * 100_000
    started = time.time()
    found = spans_of(spark, text)[0].split(",")
    assert len(found) == 100_000 and found[0] == "assign:2:16" and found[-1] == f"assign:{17 * 99_999 + 2}:{17 * 99_999 + 16}"
    rows = credentials.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert rows.text == "é [SECRET] " * 100_000 and time.time() - started < 90


def test_redaction_keeps_rows_and_columns(spark, odd):
    rows = credentials.redact(odd)
    assert rows.columns == odd.columns and rows.count() == len(ODD)
    changed = rows.where("doc_id IS NULL").first()
    assert changed.text == "null id [SECRET]" and changed.n_chars == 16
    assert credentials.redact(odd.limit(0)).count() == 0


# -- op2 --
def shingle_set(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, data, texts):
    got = {r.doc_id: r for r in fingerprints.op2_document_fingerprints(spark, data).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for i, d in enumerate(order):
        following, half = texts[order[(i + 1) % len(order)]], len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + following[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[d].near_edited - jaccard(shingle_set(texts[d]), shingle_set(edited)), got[d].near_next - jaccard(shingle_set(texts[d]), shingle_set(following))]
    assert np.abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_fingerprints_of_odd_rows(spark, odd):
    rows = fingerprints.fingerprint(odd).collect()
    prints = {r.fingerprint for r in rows if r.doc_id == 1}
    assert len(prints) == 1 and [r.fingerprint for r in rows if r.doc_id in (2, 3, 7)] == ["", "", ""]
    assert fingerprints.next_document(odd).count() == len(ODD) and fingerprints.next_document(odd.limit(0)).count() == 0
    single = fingerprints.next_document(odd.where("doc_id = 3")).first()
    assert single.next_text == single.text
    table = fingerprints.minima([b"a b c d e f", b"a b c d e f", b"z"])
    assert fingerprints.likeness(table[:1], table[1:2])[0] == 1 and fingerprints.likeness(table[:1], table[2:])[0] < 0.1


# -- op3, op8 --
def test_word_ids_equal_the_library(texts):
    table = word_tokens.chunk_ids(WORDS)
    rng = random.Random(1)
    letters = "aA'sStTrReEdDmllL 'é́É.,!#12٣ \t\n  \x1c\x85ΣςσİIẞﬁ漢字🙂‍́ñ|<|endoftext|>"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)] + list(texts.values())[:100]
    for text in some:
        assert np.frombuffer(table.encode(text), "<u4").tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, odd):
    rows = packing.pack_documents(odd, WORDS).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    table = word_tokens.chunk_ids(WORDS)
    for doc_id, text in ((r[0], r[1] or "") for r in ODD):
        data = table.encode(text) + bytes(4)
        want = [(k // 8192, k // 4, len(data[k : k + 8192]) // 4, zlib.crc32(data[k : k + 8192])) for k in range(0, len(data), 8192)]
        own = rows[rows.doc_id.isna()] if doc_id is None else rows[rows.doc_id == doc_id]
        assert set(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == set(want)
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_bounds_hold_and_rounds_never_lose(spark):
    rng = np.random.default_rng(3)
    for size in (10, 100, 2048):
        for _ in range(30):
            lengths = rng.integers(1, size + 1, 60)
            _, _, filled = packing.best_fit(lengths, size)
            assert packing.lower_bound(lengths, size) <= len(filled) and filled.sum() == lengths.sum() and filled.max() <= size
    assert packing.lower_bound(np.full(10, 1030), 2048) == 10
    lengths = [int(x) for x in rng.integers(600, 800, 500)]
    rows = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing._PIECES)
    packed = packing.pack(rows).toPandas()
    assert sorted(packed.length) == sorted(lengths) and packed.sequence_id.nunique() <= 251


def test_token_files(spark, odd, tmp_path):
    token_files.write_tokens(odd, f"file://{tmp_path}/t", WORDS)
    rows = token_files.read_tokens(spark, f"file://{tmp_path}/t").toPandas()
    rows = rows.sort_values("start", ignore_index=True)
    assert (rows.start == rows.n_tokens.cumsum() - rows.n_tokens).all() and len(rows) == len(ODD)
    assert rows.doc_id.tolist()[1:] == sorted(x[0] for x in ODD if x[0] is not None)
    assert all(ids[-1] == 2 for ids in rows.ids)
    import glob

    import pyarrow.parquet as pq

    kinds = {}
    for file in glob.glob(f"{tmp_path}/t/data/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        for c in range(group.num_columns):
            column = group.column(c)
            assert column.has_offset_index and column.has_column_index
            kinds.setdefault(column.path_in_schema, set()).update(column.encodings)
    assert all("DELTA_BINARY_PACKED" in kinds[c] for c in ("doc_id", "local_start", "n_tokens"))
    assert "RLE_DICTIONARY" in kinds["ids.list.element"]
    # a reader of the counters alone reads these columns alone
    plan = token_files.read_tokens(spark, f"file://{tmp_path}/t").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    token_files.write_tokens(odd.limit(0), f"file://{tmp_path}/none", WORDS)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


# -- op4 --
def test_byte_bpe_equals_the_library(spark, texts, odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    letters = "aA'sStTrReEdDmllLvV '''   é́É.,!#12٣ \t\n\n  \x1c\x85 Σσİẞﬁ漢字🙂‍́ñ|<|endoftext|>²½"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["x" * 5000, "'ll've", " 's", "\n's"] + list(texts.values())[:100]
    found = [x for part in byte_bpe.encode_texts(some, BYTES) for x in part]
    for text, (ids, starts, counts) in zip(some, found, strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert sum(counts) == len(ids)
        if len(starts) > 2:
            cut = [*starts.tolist(), len(text)]
            assert byte_bpe.decode_slices(np.array(ids[counts[0] : counts[0] + counts[1]]), counts[1:2], BYTES) == text[cut[1] : cut[2]].encode()
    encoded = byte_bpe.encode(odd, BYTES)
    rows = byte_bpe.decode(encoded, BYTES).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((x[1] or "").encode() for x in ODD)
    # the slices that begin at code points 7 to 13
    part = {r.doc_id: (bytes(r.decoded), r.ids) for r in byte_bpe.decode(encoded, BYTES, 7, 14).collect()}
    assert part[1][0] == b" sat on" and part[3][0] == part[2][0] == b"" and part[4][0] == b"1 word"
    assert part[1][1] == library.encode_ordinary(" sat on")
    assert byte_bpe.decode(byte_bpe.encode(odd.limit(0), BYTES), BYTES).count() == 0


def test_byte_bpe_merges_new_slices_together(monkeypatch):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    words = [" " + "".join(rng.choice("abcdeéñßхж漢") for _ in range(rng.randint(1, 60))) for _ in range(5000)]
    alone, one = [], byte_bpe.Merges.merge
    monkeypatch.setattr(byte_bpe.Merges, "merge", lambda self, data: alone.append(data) or one(self, data))
    monkeypatch.setattr(byte_bpe, "_loaded", {})
    monkeypatch.setattr(byte_bpe, "SLOTS", 64)  # most slices meet others in their place
    texts = ["".join(words), "", "".join(words[::-1]), "a\0 a a\0\0"]
    found = [x for part in byte_bpe.encode_texts(texts, BYTES) for x in part]
    for text, (ids, _, counts) in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert byte_bpe.decode_slices(np.frombuffer(ids, "<u4"), counts, BYTES) == text.encode()
    assert alone and min(map(len, alone)) > 48


# -- op5 --
def brute_components(prints, budget=3):
    items = sorted(prints)
    root = {i: i for i in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in items}


def test_simhash(spark, data, texts):
    rows = {r.doc_id: r for r in simhash.op5_simhash_near_dedup(spark, data).collect()}
    for d, text in texts.items():
        w = text.encode().lower().split()
        runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert int(rows[d].fingerprint, 16) == want
    want = brute_components({d: int(r.fingerprint, 16) for d, r in rows.items()})
    assert {d: r.component_id for d, r in rows.items()} == want


def test_trie_walk_loses_no_pair(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))) for s in seeds for _ in range(5)]
    values = np.unique(np.concatenate([seeds, np.array(flips, np.uint64)]))
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(values, None, 0, 0) for i, j in zip(a, b)}
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(far <= 3, 1)))}
    half = len(values) // 2
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(values[:half], values[half:], 0, 0) for i, j in zip(a, b)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(far[:half, half:] <= 3))}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {(r.item, r.root) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(1, 41)}


def test_large_nodes_are_dealt_out_deeper(spark):
    """Fingerprints that share a prefix, more than a node may hold, beside others."""
    rng = np.random.default_rng(8)
    near = np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 40, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 300).astype(np.uint64))
    values = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    distinct = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    want = brute_components({int(x): int(x) for x in values})
    for size in (1 << 18, 64, 8):
        assert (simhash.node_pairs(distinct, 3, size)[0].where("big >= 0").count() > 0) == (size < 100)
        root = {x: x for x in want}
        found = simhash.components(simhash.links(distinct, 3, size)).collect()
        root |= {r.item % 2**64: r.root % 2**64 for r in found}
        groups = lambda of: {frozenset(x for x in of if of[x] == r) for r in set(of.values())}
        assert groups(root) == groups(want)


def test_simhash_of_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (2, 3, 7)} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_copies(spark, odd):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 400)) for _ in range(150)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:20]):
        w = t.split()
        w[20], w[90] = "edited", "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == list(range(40))
    kept = near_copies.one_of_each(odd)
    # 1 once; 2 stands for 3 (empty); 7 has a text of its own but no words; 4 stands for 5
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 4, None, 2**40} and kept.where("doc_id = 1").count() == 1
    assert near_copies.one_of_each(odd.limit(0)).count() == 0


def test_near_copies_of_a_star(spark):
    """Variants that are near copies of the base alone, and texts that only an exact join can settle."""
    rng = random.Random(19)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 1001):
        own = list(words)
        for k in rng.sample(range(5, 390), 8):
            own[k] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    alike = lambda a, b: len(a & b) / len(a | b)
    near = [i for i in range(1, 1001) if alike(shingles[0], shingles[i]) >= 0.8]
    assert len(near) > 900 and all(alike(shingles[a], shingles[b]) < 0.8 for a, b in zip(near[:-1:9], near[1::9]))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and alike(shingles[a], shingles[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_copies_equal_brute_force(spark):
    """Families of texts around the bound, some linked to their base, some to another, some to none."""
    rng = random.Random(23)
    rows = []
    for family in range(12):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 6, 12, 60, 200]))]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"own{rng.randint(0, 50)}"
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 12 < len(set(root)) < 250
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == sorted(set(root))
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs, block=4).collect()) == sorted(set(root))


def test_common_shingles_are_counted_over_all_texts(spark):
    line, rare = "one line that all hold", "a few of them hold this"  # the latter by 25
    texts = spark.range(25_000).selectExpr(f"concat('{line} ', id, if(id % 1000 = 7, ' {rare}', '')) AS text")
    values, counts = near_copies.common_shingles(texts)
    expected = {int(near_copies._sets([t])[1][0]): n for t, n in ((line, 25_000), ("a few of them hold", 25), ("few of them hold this", 25))}
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == expected


def test_common_shingles_pass_on_few_rows_however_texts_are_dealt(spark):
    """Shingles of a single text are counted in places, not passed on, also if a task has few texts."""
    texts = [f"one line that all hold {i} {i + 1} {i + 2} {i + 3} {i + 4}" for i in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 9])], ["text"]) for i in range(0, 900, 9)]
    placed = [near_copies._placed(iter([b])) for b in batches]
    rows = pd.concat([b.to_pandas() for p in placed for b in p])
    assert len(rows) == 100 * near_copies.STRETCHES and set(rows["texts"]) == {9}
    bits = b"".join(near_copies._crowded(g)["bits"].iloc[0] for _, g in rows.groupby("stretch"))
    told = [b.num_rows for part in batches for b in near_copies._held_there(np.frombuffer(bits, np.uint8))(iter([part]))]
    assert sum(told) < 150  # the line once a task, and what shares a place
    many = spark.createDataFrame([(t,) for t in texts], "text string").repartition(100)
    values, counts = near_copies.common_shingles(many)
    assert values.tolist() == [int(near_copies._sets(["one line that all hold"])[1][0])] and counts.tolist() == [900]
    assert [len(x) for x in near_copies.common_shingles(many.limit(0))] == [0, 0]


def test_whole_simhashes(spark):
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 3, 255, 256, 1000])
    value = rng.integers(0, 1 << 63, n.sum(), dtype=np.int64)
    got = near_copies.simhashes(value, n)
    for t, (a, b) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
        for k, seed in enumerate(near_copies._SEEDS):
            hashes = arrays.mixed(value[a:b].view(np.uint64) ^ seed)
            assert int(got[t, k]) == sum(1 << bit for bit in range(64) if 2 * int((hashes >> np.uint64(bit) & np.uint64(1)).sum()) > n[t])


# -- op6 --
def test_quality(spark, odd):
    data = "/root/testdata/sf0.1"
    rows = quality.op6_quality_classifier(spark, data).toPandas().merge(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{data}/labels.parquet/*', union_by_name=true)").df() if __import__("os").path.isdir(f"{data}/labels.parquet") else duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").df(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.97 and held.score.between(0, 1).all()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = quality.train(odd, none)
    assert {r.score for r in quality.score(odd, machine, ["doc_id"]).select("score").collect()} == {1.0}
    fitted = quality.Machine().fit([b"good text here", b"BAD!! BAD!!"] * 20, np.array([1.0, 0.0] * 20))
    assert quality.score(odd, fitted, ["doc_id", "score"]).count() == len(ODD) and len(fitted.score([b"", b" "])) == 2


def test_pairs_in_linear_time():
    machine = quality.Machine()
    first, index, value = quality.inputs([b"some words and some more", b""])
    raw, _ = machine.raw(first, index, value)
    for t in range(2):
        own = slice(first[t], first[t + 1])
        pairs = sum(machine.factors[index[own][i]] @ machine.factors[index[own][j]] * value[own][i] * value[own][j] for i in range(first[t + 1] - first[t]) for j in range(i))
        assert raw[t] == pytest.approx(pairs + machine.weights[index[own]] @ value[own])


# -- op9 --
def test_topk_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1, 1500)]
    rows += [(0, [1.0] * 6), (100, [1.0] * 6), (100, [1.0] * 6), (2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (2004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id").isin(0, 200)).toPandas().sort_values(["query_id", "rank"])
    usable = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and len(v) == 6]
    for q in (0, 200):
        own = next(v for i, v in usable if i == q)
        want = sorted(((-int(own @ v), i) for i, v in usable if i != q))[:10]
        assert got[got.query_id == q][["vec_id", "score"]].values.tolist() == [[i, -s] for s, i in want]
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_topk_of_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    big = [(1, [2e6, 2e6]), (2, [-2e6, 1.0]), (3, [1.9e6, 1.9e6]), (4, [2e6, -1.0])]
    got = topk.search(spark.createDataFrame(big, schema), F.col("vec_id") == 1).collect()
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in big}
    want = sorted((-sum(a * b for a, b in zip(whole[1], whole[i])), i) for i in (2, 3, 4))
    assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == want and want[0][0] < -(2**62)
    # a score beyond 64 bits, or a component, isn't told wrongly
    for huge in ([1e17, 1e17], [1e12, 1e12]):
        with pytest.raises(Exception, match="64 bits"):
            topk.search(spark.createDataFrame([(1, huge), (2, huge)], schema), F.col("vec_id") == 1).collect()


def test_topk_over_shelves(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SHELF", 2)
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centre[i // 40] + rng.normal(size=8) / 9]) for i in range(800)]
    rows += [(40, rows[40][1])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 40 == 0)
    found = got.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")).collect()
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    assert len(found) == 20
    for r in found:
        own = next(v for i, v in whole if i == r.query_id)
        want = sorted((-int(own @ v), i) for i, v in whole if i != r.query_id)[:10]
        assert [(x.rank, x.vec_id, x.score) for x in r.best] == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


# -- op10 --
URLS = ["http://www.example.com/en/a", "http://EXAMPLE.com/en/", "https://sub.example.com/fr?x#y", "http://a.net/es/1", "http://a.net/de/", None, "no scheme", "http://x.org/ads/1?utm_source=a", "http://com", "ftp://com/", "http://x.org/wp-admin", "http://x.org/wp-content"]


def judged(spark, urls):
    """The rows that both ways of judging give."""
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    one = {r.page_id: r for r in url_rules.judge(df).collect()}
    hosts = spark.createDataFrame(url_rules.HOST_RULES, "host string, path string, verdict string")
    patterns = spark.createDataFrame([(p, list(r)) for p, required in url_rules.PATTERN_RULES for r in required], "pattern string, required array<string>")
    other = {r.page_id: r for r in url_rules.judge_by_tables(df, hosts, patterns).collect()}
    assert one == other and len(one) == len(urls)
    return one


def test_urls(spark):
    got = judged(spark, URLS)
    assert [got[i].verdict for i in range(len(URLS))] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert [got[i].rule for i in range(4)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/"] and got[8].rule is None
    assert (got[2].host, got[2].path) == ("sub.example.com", "/fr") and (got[5].host, got[6].path) == ("", "")
    # repeated rows all return, an empty table gives none
    twice = spark.createDataFrame([(7, u) for u in URLS + URLS], "page_id long, url string")
    assert url_rules.judge(twice).count() == 2 * len(URLS) and url_rules.judge(twice.limit(0)).count() == 0
    clash = twice.withColumns({c: F.lit("x") for c in ("host", "token", "verdict", "rule", "hit", "tokens")})
    assert url_rules.judge(clash).columns == ["page_id", "url", "host", "path", "rule", "verdict"] and url_rules.judge(clash).count() == 2 * len(URLS)


def test_urls_with_numbered_hosts(spark):
    urls = ["http://ads2.site.org/", "https://banner12.x.org/a", "http://ad7.x.org", "http://adserver3.x.org/", "http://ads2x.site.org/", "http://x.org/7/ads2"]
    assert [judged(spark, urls)[i].verdict for i in range(6)] == ["block", "block", "block", "block", "allow", "allow"]


def test_rules_are_filed_under_their_rarest_token():
    rules = [("/wp-(admin|login)", [["wp", "admin"], ["wp", "login"]]), ("x", [["a", "b", "c"]])]
    filed = url_rules.index_rules(rules, {"wp": 5, "admin": 9, "login": 2, "a": 3, "b": 3, "c": 4})
    assert filed == {"wp": ["/wp-(admin|login)"], "login": ["/wp-(admin|login)"], "a": ["x"]}


def test_token_index_loses_no_match(spark):
    rng = random.Random(3)
    bits = ["ads", "ad", "banner", "12", "utm_source=", "?", "&", "/", ".", "://", "wp-", "admin", "login", "x", "gclid=", "exe", "cart", "sid=", "tracker", "sponsored"]
    urls = ["http://" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    want = ["block" if any(re.search(p, u) for p, _ in url_rules.PATTERN_RULES) else "allow" for u in urls]
    got = judged(spark, urls)
    assert [got[i].verdict for i in range(len(urls)) if got[i].rule is None] == [w for i, w in enumerate(want) if got[i].rule is None]
    assert 50 < want.count("block") < 550


def test_words_of_bytes():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab \n") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    words = arrays.Words(texts)
    assert words.counts.tolist() == [len(t.split()) for t in texts]
    seen = {}
    for (a, b), h in zip(zip(words.begin, words.end), words.hashes):
        assert seen.setdefault(words.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_ids_of_all_code_points_equal_the_library():
    """In context, alone and behind a letter; newer letters and controls among them."""
    table = word_tokens.ChunkIds(WORDS)
    points = [i for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF]
    for pattern in ("a{0}b", "x{0}y {0}", "AᲉ{0}"):
        texts = [pattern.format(chr(i)) for i in points]
        for begin in range(0, len(texts), 20000):
            part = texts[begin : begin + 20000]
            for text, found in zip(part, table.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                assert np.frombuffer(table.encode(text), "<u4").tolist() == found.ids, ascii(text)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x300, 0x2000), rng.randrange(0x10000, 0x11F00), 32, 0x301])) for _ in range(20))
        assert np.frombuffer(table.encode(text), "<u4").tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
