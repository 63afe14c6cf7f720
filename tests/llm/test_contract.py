"""Every op query on the test tables, column by column, against plain Python."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import packing, pii, quality, toxicity
from tidewire.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


def rows_of(spark, name):
    df = QUERIES[name](spark, ROOT)
    return df.dtypes, [r.asDict(True) for r in df.collect()]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    found = {}
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
        rel = con.sql(f"SELECT * FROM {t}")
        found[t] = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    return found | {"con": con}


def test_every_query_is_registered_and_has_its_columns(spark):
    want = {
        "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op3_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
        "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op6_urls": "page_id bigint, host string, path string, rule string, verdict string",
        "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>",
        "op9_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    }
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    for name, columns in want.items():
        have = dict(QUERIES[name](spark, ROOT).dtypes)
        assert {c.split(" ")[0]: c.split(" ")[1] for c in columns.split(", ")}.items() <= have.items(), name


def test_op2_pieces(spark, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    _, rows = rows_of(spark, "op2_packing")
    ids = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2] for d in tables["documents"]}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            own = np.asarray(ids[doc][at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[doc]), zlib.crc32(own))
            at += r["length"]
        assert at == len(ids[doc])
    for own in by_sequence.values():
        total = sum(r["length"] for r in own)
        assert sorted(r["offset"] for r in own) == [0] and total <= 4096 and total & (total - 1) == 0


def test_op2_buckets_are_written(spark, tmp_path):
    pieces = packing.pack(spark.read.parquet(f"{ROOT}/documents.parquet"))
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == pieces.count() and back.where("length <> pow(2, bucket)").count() == 0
    assert packing.swapped(packing.swapped(b"\x01\x02\x03\x04abcd")) == b"\x01\x02\x03\x04abcd" and packing.swapped(b"\x01\x02\x03\x04") == b"\x04\x03\x02\x01"


def test_op3_neighbours(spark, tables):
    _, rows = rows_of(spark, "op3_neighbours")
    ids = np.asarray([e["vec_id"] for e in tables["embeddings"]])
    x = np.asarray([e["embedding"] for e in tables["embeddings"]], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(dict)
    for r in rows:
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        sims = x @ x[ids == q][0]
        best = [(-s, i) for s, i in zip(sims, ids, strict=True) if i != q]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(sims[ids == i][0] - s) < 1e-9 for i, s in found.values())
        assert [s for _, s in (found[k] for k in sorted(found))] == sorted((s for _, s in found.values()), reverse=True)
        hits += len({i for _, i in sorted(best)[:5]} & {i for i, _ in found.values()})
    assert hits >= 0.9 * 5 * len(got)


def test_op4_records(spark, tables):
    _, rows = rows_of(spark, "op4_warc")
    bodies = {p["page_id"]: (p["html"] or "").encode() for p in tables["pages"]}
    largest = {}
    for i, b in bodies.items():
        largest[b] = max(i, largest.get(b, i))
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if largest[b] == i else "revisit", None if largest[b] == i else largest[b]) for i, b in bodies.items()}
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize(("name", "modulus", "held", "label"), [("op5_quality", 5, 0, "quality"), ("op8_toxicity", 4, 2, "toxic")])
def test_op5_and_op8_scores(spark, tables, name, modulus, held, label):
    _, rows = rows_of(spark, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in tables["documents"])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = {x["doc_id"]: x[label] for x in tables["labels"]}
    right = [r["predicted"] == known[r["doc_id"]] for r in rows if r["doc_id"] in known and not r["held_out"]]
    assert np.mean(right) >= 0.85
    if name == "op8_toxicity":
        texts = {d["doc_id"]: d["text"] or "" for d in tables["documents"]}
        for r in rows:
            assert all(0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) and s["score"] >= 0.3 for s in r["sentences"])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, tables, name):
    df = QUERIES[name](spark, ROOT)
    rel = tables["con"].sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = collections.Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_op9_checksums(spark, tables):
    _, rows = rows_of(spark, "op9_shards")
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in tables["documents"]}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)


#: The patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in GIVEN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()  # noqa: B023
            if good:
                found.append((kind, *m.span()))
    return found


def test_op10_base(spark, tables):
    _, rows = rows_of(spark, "op10_pii")
    texts = {d["doc_id"]: d["text"] or "" for d in tables["documents"]}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    order = list(GIVEN)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in order] == [sum(x[0] == k for x in base) for k in order]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        spans = [(k, int(s), int(e)) for k, s, e in spans]
        assert len(spans) == r["n_spans"] and set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (order.index(x[0]), x[1]))


def test_normal_equations_and_isotonic_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    stats = rng.normal(size=(400, quality._STATS)) * rng.uniform(0.5, 20, quality._STATS)
    label = (stats[:, 0] / 10 + rng.normal(size=400) > 0).astype(float)
    rows = [(s.tolist(), float(y), int(i % quality.FOLDS)) for i, (s, y) in enumerate(zip(stats, label, strict=True))]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, label double, fold int").repartition(7))
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, stats.std(axis=0))

    def ridge(x, y):
        a = np.vstack([x, np.sqrt(quality.RIDGE) * np.eye(x.shape[1])[:-1]])
        return np.linalg.lstsq(a, np.concatenate([y, np.zeros(x.shape[1] - 1)]), rcond=None)[0]

    x = model.map(stats)
    assert np.allclose(model.weights, ridge(x, label), atol=1e-6)
    # Calibration sees each row scored by the other folds alone.
    raw = np.zeros(400)
    for f in range(quality.FOLDS):
        own = np.arange(400) % quality.FOLDS == f
        raw[own] = x[own] @ ridge(x[~own], label[~own])
    bins = np.clip(np.floor((raw + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1).astype(int)
    p, n = np.bincount(bins, label, quality.BINS), np.bincount(bins, minlength=quality.BINS)
    used = np.flatnonzero(n)
    # The isotonic fit of weighted means: the max over starts of the min over ends.
    mean = lambda i, j: p[used[i : j + 1]].sum() / n[used[i : j + 1]].sum()
    fit = [max(min(mean(i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    assert len(model.values) == len(np.unique(np.round(fit, 12))) and (np.diff(model.values) >= -0.5).all()
    at = 0
    for value in np.unique(np.round(fit, 12)):
        own = [used[k] for k in range(len(used)) if round(fit[k], 12) == value]
        assert abs(model.values[at] - (p[own].sum() + 0.5) / (n[own].sum() + 1)) < 1e-9
        at += 1


def test_noisy_or_gradient_equals_differences():
    rng = np.random.default_rng(4)
    bags = [(int(rng.integers(0, 4)), [list(map(int, rng.choice(6, rng.integers(1, 4), replace=False))) for _ in range(rng.integers(0, 4))], float(i % 2), float(rng.uniform(0.5, 2))) for i in range(20)]
    data = toxicity.Bags(bags, 6)
    w, bias, rest = rng.normal(size=6), -2.0, -1.5
    # Brute force: one minus the product over all sentences.
    value = 0.0
    for plain, known, y, weight in bags:
        none = (1 - 1 / (1 + np.exp(-rest))) * (1 - 1 / (1 + np.exp(-bias))) ** plain
        for s in known:
            none *= 1 - 1 / (1 + np.exp(-(bias + w[s].sum())))
        value += weight * np.log(1 - none if y else none)
    got = data.likelihood(w, bias, rest)
    assert abs(got[0] - value) < 1e-9
    step = 1e-6
    for i in range(6):
        e = np.eye(6)[i] * step
        assert abs(got[1][i] - (data.likelihood(w + e, bias, rest)[0] - data.likelihood(w - e, bias, rest)[0]) / (2 * step)) < 1e-5
    assert abs(got[2] - (data.likelihood(w, bias + step, rest)[0] - data.likelihood(w, bias - step, rest)[0]) / (2 * step)) < 1e-5
    assert abs(got[3] - (data.likelihood(w, bias, rest + step)[0] - data.likelihood(w, bias, rest - step)[0]) / (2 * step)) < 1e-5


def test_shared_folder_is_required_off_local_mode(spark, monkeypatch):
    from tidewire.llm import common

    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    assert common.unused("a", ["A", "a_"]) == "a__"
    path = common.new_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert F is not None and spark.read.parquet(path).count() == 3
