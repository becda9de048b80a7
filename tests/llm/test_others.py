"""PII, WARC, vectors, line dedup, mixing and toxicity against plain versions."""

import datetime
import hashlib
import itertools
import math
import os
import random
import shutil
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenbox.llm import embeddings, exact_dedup, fsio, line_dedup, mixing, ngram_join, pii, store, toxicity, warc

KEY = "k"


def _random(tweak, i, x):
    return int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()[:14], 16)


def _feistel(left, right, size_left, size_right, tweak):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + _random(tweak, i, right)) % size_left
        else:
            right = (right + _random(tweak, i, left)) % size_right
    return left, right


def _digits(d, tweak):
    n = len(d)
    u = n // 2
    a, b = _feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (n - u), f"{tweak}:{n}")
    return str(a).zfill(u) + str(b).zfill(n - u)


def _luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        s += x - 9 if x > 9 else x
    return str(-s % 10)


def _replaced(spark, *texts):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    return [r for r in pii.pseudonymize(docs, KEY).orderBy("doc_id").collect()]


def test_cards(spark):
    good = "4111111111111111"
    new = good[0] + _digits(good[1:-1], "card4")
    new += _luhn(new)
    a, b, c, d, e = _replaced(spark, f"pay {good}, or 4111-1111 1111-1111.", "4111111111111112 and 12345", None, "", f"{good} 10.20.30.40 {good}")
    assert e.kinds == ["card", "ip", "card"]
    assert a.text == f"pay {new}, or {new[:4]}-{new[4:8]} {new[8:12]}-{new[12:]}." and a.kinds == ["card", "card"] and a.n_replaced == 2
    assert (b.text, b.n_replaced) == ("4111111111111112 and 12345", 0) and (c.text, c.n_replaced, d.text) == (None, 0, "")


def test_formats(spark):
    texts = ["mail Foo.Bar@mail.example.com and foo.bar@mail.example.com", "DE89370400440532013000", "078-05-1120 666-12-1234 000-12-1234", "10.20.30.40. 999.1.1.1 01.2.3.4", "+1 (459) 555-7415", "1985-03-14 14.03.1985 3/14/1985 1985-02-30", "v1.2 3.14 2020 12:30"]
    mail, iban, ssn, ip, phone, date, clean = _replaced(spark, *texts)
    one, two = mail.text.split()[1], mail.text.split()[3]
    assert one.split("@")[0] == two.split("@")[0] != "Foo.Bar" and mail.kinds == ["email", "email"]
    assert int("".join(str(int(c, 36)) for c in iban.text[4:] + iban.text[:4])) % 97 == 1 and iban.text != texts[1] and iban.text[:2] == "DE"
    assert ssn.kinds == ["ssn"] and ssn.text.endswith(" 666-12-1234 000-12-1234") and not ssn.text.startswith("078-05-1120")
    assert ip.kinds == ["ip"] and all(0 <= int(x) <= 255 for x in ip.text.split(" ")[0].rstrip(".").split(".")) and ip.text.endswith(". 999.1.1.1 01.2.3.4")
    rest = _north_american("4595557415")
    assert phone.text == f"+1 ({rest[:3]}) {rest[3:6]}-{rest[6:]}"
    iso, dots, us, bad = date.text.split()
    assert datetime.date.fromisoformat(iso).strftime("%d.%m.%Y") == dots and bad == "1985-02-30" and date.kinds == ["date"] * 3
    assert us == datetime.date.fromisoformat(iso).strftime("%-m/%-d/%Y") or us == datetime.date.fromisoformat(iso).strftime("%-m/%d/%Y") or us.count("/") == 2
    assert (clean.text, clean.n_replaced) == (texts[-1], 0)


def _north_american(d):
    """Plainly: area codes that can be dialled, and those that cannot, are listed and permuted among themselves."""
    usable = [a for a in range(200, 1000) if a % 100 != 11]
    areas = usable if int(d[:3]) in usable else [a for a in range(1000) if a not in usable]
    low, size = (200, 8_000_000) if int(d[3:6]) >= 200 else (0, 2_000_000)
    a, r = _feistel(areas.index(int(d[:3])), int(d[3:]) - low * 10_000, len(areas), size, f"phone+1:{len(areas)}:{size}")
    return f"{areas[a]:03d}{r + low * 10_000:07d}"


def test_phones_in_one_form(spark):
    """However a number is written, its pseudonym is the same, written in that way."""
    new = _north_american("5551234567")
    a, b, c = new[:3], new[3:6], new[6:]
    one, other, bad, tail = _replaced(spark, "+15551234567 +1 555 123 4567 (555) 123-4567 555-123-4567 555.123.4567", "+33 1 23 45 67 89, +33123456789, +3531234567", "+1 211-123-4567 and 011-555-1234", "+1 459 555 7415 12 apples")
    assert one.text == f"+1{a}{b}{c} +1 {a} {b} {c} ({a}) {b}-{c} {a}-{b}-{c} {a}.{b}.{c}" and one.kinds == ["phone"] * 5
    fr = _digits("123456789", "phone+33")
    assert other.text == f"+33 {fr[0]} {fr[1:3]} {fr[3:5]} {fr[5:7]} {fr[7:]}, +33{fr}, +353{_digits('1234567', 'phone+353')}"
    x, y = _north_american("2111234567"), _north_american("0115551234")
    assert bad.text == f"+1 {x[:3]}-{x[3:6]}-{x[6:]} and {y[:3]}-{y[3:6]}-{y[6:]}"
    z = _north_american("4595557415")
    assert tail.text == f"+1 {z[:3]} {z[3:6]} {z[6:]} 12 apples"
    seen = {_north_american(f"{a:03d}{e}0000") for a in range(1000) for e in (100, 199, 200, 999)}
    assert len(seen) == 4000


def _iban(bban, country):
    number = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{bban}"


def test_every_kind_against_a_plain_version(spark):
    rng = random.Random(12)
    texts, want = [], []
    for _ in range(60):
        bban = "".join(rng.choices("0123456789", k=18))
        whole, new = _iban(bban, "DE"), _iban(_digits(bban, "ibanDE"), "DE")
        spaced = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
        texts.append(f"{whole}; {spaced(whole)}; {spaced(whole)} AND 12AB")
        want.append(f"{new}; {spaced(new)}; {spaced(new)} AND 12AB")
        area, group, serial = rng.choice([*range(1, 666), *range(667, 900)]), rng.randrange(1, 100), rng.randrange(1, 10000)
        areas = [*range(1, 666), *range(667, 900)]
        left, right = _feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        texts.append(f"{area:03d}-{group:02d}-{serial:04d}")
        want.append(f"{areas[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}")
        p = [rng.randrange(256) for _ in range(4)]
        left, right = _feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
        texts.append(".".join(map(str, p)))
        want.append(f"{left // 256}.{left % 256}.{right // 256}.{right % 256}")
        name = f"User.{rng.randrange(99)}@Mail.example.org"
        texts.append(name)
        want.append("u" + hashlib.sha256(f"{KEY}|email|{name.lower()}".encode()).hexdigest()[:32] + "@Mail.example.org")
    got = _replaced(spark, *texts)
    assert [r.text for r in got] == want and sum(r.n_replaced for r in got) == 60 * 6


def test_pii_edges(spark):
    """Null and repeated ids, an empty table, a very long text, names that clash; and the key is not in the plan."""
    long = "call 555-123-4567 now " * 20_000
    docs = spark.createDataFrame([(None, "10.20.30.40", "a", "b"), (None, None, "a", "b"), (3, "", "a", "b"), (3, long, "a", "b"), (3, long, "a", "b")], "doc_id long, text string, key string, __key string")
    got = pii.pseudonymize(docs, "very secret")
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "n_replaced", "kinds"] and sorted(r.n_replaced for r in rows) == [0, 0, 1, 20_000, 20_000]
    a, b = (r.text for r in rows if r.n_replaced == 20_000)
    assert a == b and len(a) == len(long) and "very secret" not in got._jdf.queryExecution().toString()
    assert pii.pseudonymize(docs.limit(0), "k").count() == 0


def test_dates_are_permuted(spark):
    first = datetime.date(2000, 1, 1)
    days = spark.range(36525).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit(first), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = pii.pseudonymize(days, KEY)
    assert got.agg(F.count_distinct("text"), F.min("text"), F.max("text")).first() == (36525, "2000-01-01", "2099-12-31")
    n = 8000
    a, b = _feistel(n // 487, n % 487, 75, 487, "date2000")
    assert got.where(f"doc_id = {n}").first().text == (first + datetime.timedelta(a * 487 + b)).isoformat()


def test_numbers_are_permuted(spark):
    d = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("+49 "), F.lpad(F.floor(F.col("id") / 10), 4, "0"), F.lit("-555"), F.col("id") % 10).alias("text"))
    assert pii.pseudonymize(d, KEY).agg(F.count_distinct("text"), F.min("n_replaced")).first() == (10_000, 1)


PAGES = [(i, f"http://e/{i}", ("p%d " % (i % 7)) * 400 if i % 3 else "short") for i in range(60)] + [(None, None, None), (100, "http://e/a b\r\nX: y", "é" * 2000), (101, None, "é" * 2000), (101, None, "é" * 2000), (None, None, "é" * 2000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, shard string")
    out = []
    for k, parts in enumerate((1, 5)):
        m = warc.write_warc(pages.repartition(parts), f"file://{tmp_path}/{k}", shard_bytes=20_000, file_bytes=500)
        out.append({r.path.rpartition("/")[2]: r.sha256 for r in m.collect()})
    assert out[0] == out[1] and len(out[0]) > 5  # the same names and bytes, however the rows came
    assert not (tmp_path / "0" / ".temporary").exists()
    got = warc.read_warc(m).collect()
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max([x for x in (last.get(h or ""), i) if x is not None], default=None)
    assert len(got) == len(PAGES)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest and r.payload_bytes == len(r.payload)
    for i, _, h in PAGES[:61]:
        (r,) = [r for r in got if r.page_id == i and r.payload_digest == hashlib.sha1((h or "").encode()).hexdigest()]
        want = i is not None and len(h or "") >= 1000 and last[h or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", last[h]) if want else ("response", None))
    big = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes == 4000)
    assert big == [(0, "revisit", 101), (100, "revisit", 101), (101, "response", None), (101, "revisit", 101)]
    data = fsio.read(m.first().path)
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_odd_ids(spark, tmp_path):
    """The smallest and largest ids, one far away from all others, and one that holds most rows: shards are even in bytes."""
    rows = [(i, None, f"page {i} " * 300) for i in range(400)] + [(i, None, "x" * 50) for i in (-(1 << 63), (1 << 63) - 1, 1 << 60)] + [(77, f"http://e/{i}", f"other {i} " * 300) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    m = warc.write_warc(pages, f"file://{tmp_path}/odd", shard_bytes=100_000, file_bytes=50_000)
    each = m.groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert len(each) > 10 and max(r.n for r in each) < 150 and sum(r.n for r in each) == len(rows)
    got = sorted((r.page_id, r.payload_digest, r.record_type) for r in warc.read_warc(m).collect())
    assert got == sorted((i, hashlib.sha1(h.encode()).hexdigest(), "response") for i, _, h in rows)
    paths = [r.path.rpartition("/")[2] for r in m.orderBy("shard", "serial").collect()]
    assert paths == sorted(paths) and not os.path.exists(tmp_path / "odd" / ".temporary")


def test_records_in_blocks():
    records = [warc.page_record(i, None, bytes([i]) * (i * 997), None, False) for i in range(40)]
    data = b"".join(records)
    for size in (1, 700, 1 << 14, len(data)):
        got = list(warc.records(data[a : a + size] for a in range(0, len(data), size)))
        assert [r.payload for r in got] == [bytes([i]) * (i * 997) for i in range(40)]
    assert list(warc.records(b"")) == [] and [r.payload for r in warc.records(data)] == [r.payload for r in got]


def _vectors(rng):
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((n, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])).astype(np.float32).tolist(), label))
                n += 1
    hot = rng.normal(size=16)
    rows += [(n + i, (hot + rng.normal(size=16) * 0.1).astype(np.float32).tolist(), 1) for i in range(700)]
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 16, 0), (5003, [float("nan")] + [1.0] * 15, 0), (5004, [None] + [1.0] * 15, 0), (5005, [1.0] * 15, 0), (5006, [1.0] * 16, 0), (5007, [3.0] * 16, 0), (5008, [3.0] * 16, 0), (5009, [float("inf")] * 16, 0)]
    return rows


def test_vectors(spark):
    rows = _vectors(np.random.default_rng(2))
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<float>, label int, links double")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    fine = {i: np.array(v, np.float64) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    up, links = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(fine)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if label[i] == label[j] and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / (math.sqrt(fine[i] @ fine[i]) * math.sqrt(fine[j] @ fine[j])) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], find(i), find(i) == i)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_odd_vectors(spark):
    """Components beyond single precision, classes of null ids, labels of text, repeated ids, clashing column names."""
    near, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, [1e39, 1e39], "a"), (1, [1e39, 1e39], "a"), (2, [1e-60, 2e-60], "a"), (3, [1e-60, 2e-60], "a"), (4, [1e300, 1e300], "a"), (5, [1e-300, 2e-300], "a")]
    rows += [(10, near, "b"), (None, [1.0, 0.01, 0.0], "b"), (None, [1.0, 0.01, 0.0], "b"), (11, [1.0, 0.02, 0.0], "b"), (None, far, "b"), (None, [0.0, 1.0, 0.01], "b")]
    rows += [(20, near, "c"), (20, near, "c"), (21, far, "c"), (21, near, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label string, cid int, key int, m int")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in embeddings.near_vectors(df).collect())
    # 0, 1 and 4 are of one direction, 2, 3 and 5 of another, and 0.9487 apart
    want = [(0, 2, 0, True), (1, 2, 0, False), (4, 2, 0, False), (2, 2, 2, True), (3, 2, 2, False), (5, 2, 2, False)]
    want += [(10, 3, 10, True), (-1, 3, 10, False), (-1, 3, 10, False), (11, 3, 10, False), (-1, 1, -1, False), (-1, 1, -1, False)]
    want += [(20, 1, 20, True), (20, 1, 20, True), (21, 0, 21, True), (21, 0, 21, True)]
    assert got == sorted(want)


def test_tables_are_removed(spark):
    """What an operator leaves behind is what its result reads, and the result can be read again."""
    root = store.shared_root(spark).removeprefix("file:")
    os.makedirs(f"{root}/lumenbox", exist_ok=True)
    left = lambda: {n.rpartition("-")[0] for n in os.listdir(f"{root}/lumenbox")}
    for n in os.listdir(f"{root}/lumenbox"):
        if not n.startswith("files"):
            shutil.rmtree(f"{root}/lumenbox/{n}")
    vec = spark.createDataFrame([(i, [1.0, 0.01 * (i % 9), 0.0], 1) for i in range(40)], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(vec)
    assert got.count() == 40 and left() == {"vector-classes", "vector-links", "components", "component-names"} and got.count() == 40
    docs = spark.createDataFrame([(i, f"a text of some words that are shared by many {i % 5}", "s") for i in range(40)], "doc_id long, text string, source string")
    for frame, names in ((ngram_join.ngram_join(docs), {"meta", "classes", "components", "component-names"}), (mixing.mix(docs), {"mix", "decisions"}), (line_dedup.line_dedup(docs, whole=True), {"line-bodies"})):
        before = left()
        assert frame.count() == 40 and names <= before and not {"profile", "sets", "lists", "pairs", "rank0", "plan", "line-chunks", "stars", "links"} & before


def test_shuffle_files_are_removed(spark):
    """Of what op4 shuffles for its tables nothing is on disk once they are written, and the session's settings are as before."""

    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {int(name.split("_")[1]) for path in files if (name := os.path.basename(path)).startswith("shuffle_")}

    docs = spark.createDataFrame([(i, f"a line\nthat is shared\nby many {i % 5}\n") for i in range(40)], "doc_id long, text string")
    before, setting = kept(), spark.conf.get(store._CLEANUP)
    got = line_dedup.line_dedup(docs, whole=True)
    until = time.monotonic() + 10  # they go in the background
    while len(kept() - before) > 1 and time.monotonic() < until:
        time.sleep(0.1)
    assert len(kept() - before) <= 1 and spark.conf.get(store._CLEANUP) == setting  # the one is a row of sums, of spread_join
    want = _without_passages([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.text for r in got.collect()} == want and {r.doc_id: r.text for r in got.collect()} == want


def test_workers_give_memory_back(spark):
    """What a Python worker has freed is not kept for the steps that follow."""

    def probe(batches):
        import ctypes
        import pathlib
        import re

        kept = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
        list(batches)
        before = kept()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        time.sleep(1)  # so that no worker takes two of these tasks
        yield pa.RecordBatch.from_pydict({"mb": pa.array([before - kept()], pa.int64())})

    text = F.concat_ws(" ", *[F.hex(F.xxhash64("doc_id", F.lit(i))) for i in range(100)])
    docs = store.save(spark.range(0, 16000, 1, 4).select(F.col("id").alias("doc_id")).withColumn("text", text), "long-texts")
    left = []
    for frame in (toxicity.score(docs, toxicity.fit([], np.zeros(0))), exact_dedup.owners(docs)):
        frame.write.format("noop").mode("overwrite").save()
        left.append([r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(probe, "mb long").collect()])
    assert all(len(x) == 4 and max(x) < 24 for x in left), left  # the last batch goes after the task
    store.forget(docs)


def test_spread_join(spark):
    """Hot keys and the others, against the plain join."""
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("long").alias("key"), "id")
    right = store.save(left.groupBy("key").agg(F.count("*").alias("n")).where("key % 2 = 1"), "right")
    got = store.spread_join(left, right, "key", "n", F.xxhash64("id"))
    assert got.columns == ["key", "id", "n"] and "Broadcast" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_table_plan():
    for n in (0, 10, 1000, 10**6, 10**10):
        bits, tables = embeddings.table_plan(n, 0.98)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= embeddings.MISS


def _lines(rng, n):
    return "".join(f"line {rng.randrange(10**9)}\n" for _ in range(n))


def _plain_chunks(text):
    """Chunks by the definition, on plain integers: lines, their hashes, sums of three of them, every fourth on average ends one."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def named(line):
        return mix((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(line)) + len(line) * 0xD6E8FEB86659FD93) & m)

    odd = [2 * (mix(11 + j) >> 1) + 1 for j in range(3)]
    lines = (text or "").encode().splitlines(keepends=True) if text else []
    out, at, begin, first = [], 0, 0, 0
    for i, line in enumerate(lines):
        at += len(line)
        rolled = sum(named(lines[i - j]) * odd[j] for j in range(min(3, i + 1))) & m
        if mix(rolled) % 4 == 0 or i == len(lines) - 1:
            out.append((begin, at, i + 1 - first))
            begin, first = at, i + 1
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    passage = _lines(rng, 40)
    rows = [(10 + i, _lines(rng, rng.randrange(9)) + passage + _lines(rng, rng.randrange(9))) for i in range(30)]
    rows += [(1, None), (2, ""), (3, "one line"), (4, "one line"), (None, passage), (5, "é\nà\n" * 50), (5, "é\nà\n" * 50), (6, "\n" * 5)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string")
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    chunks = [_plain_chunks(t) for _, t in rows]
    assert chunks == [list(line_dedup.chunk_bounds(pa.array([t or ""])))[0] for _, t in rows]
    places = {}
    for (i, t), bounds in zip(rows, chunks, strict=True):
        for no, (a, b, n) in enumerate(bounds):
            if n >= 2 and i is not None:
                places.setdefault(t.encode()[a:b], []).append((i, no))
    want = []
    for (i, t), bounds in zip(rows, chunks, strict=True):
        raw, keep = (t or "").encode(), b""
        for no, (a, b, n) in enumerate(bounds):
            if n < 2 or i is None or min(places[raw[a:b]]) == (i, no):
                keep += raw[a:b]
        want.append((i, keep.decode()))
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_removed > 0 for r in got) >= 29  # the passage goes wherever it starts
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def _without_passages(rows):
    """By brute force: lines in a pair of lines that stands earlier go, blank lines between them, too."""
    seen, want = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(full, full[1:]):
            own = seen.setdefault("\n".join(lines[a : b + 1]), (i, a, b))
            if own != (i, a, b):
                gone |= {k for k in range(a, b + 1) if own[0] != i or k > own[2]}
        parts = [x + "\n" for x in lines[:-1]] + lines[-1:]
        want[i] = "".join(x for k, x in enumerate(parts) if k not in gone)
    return want


def test_whole_passages(spark):
    rng = random.Random(5)
    rows, planted = [], []
    for n in range(2, 11):
        for _ in range(12):
            passage = _lines(rng, n)
            for _ in range(3):
                i = len(rows)
                end = rng.random() < 0.3
                rows.append((i, _lines(rng, rng.randrange(5)) + (passage[:-1] if end else passage + _lines(rng, 1 + rng.randrange(5)))))
                planted.append((i, passage.split("\n")[:-1]))
    rows += [(1000, "a\n\nb\n\n\nc"), (1001, "x\na\n\nb\n\n\nc\ny"), (1002, "\n" * 5), (1003, "\n" * 5), (1004, "e\n" * 5), (1005, "é\nà\n" * 9), (1006, "single\nq"), (1007, "single\nr"), (1008, "e\ne")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert {i: r.text for i, r in got.items()} == _without_passages(rows)
    for (i, passage), first in zip(planted, [True, False, False] * 108, strict=True):
        left = set(got[i].text.split("\n"))
        assert all((x in left) == first for x in passage)  # recall 1, and the first place is whole
    assert got[1001].text == "x\ny" and got[1003].text == "\n" * 5 and got[1004].text == "e\ne\n" and got[1005].text == "é\nà\n" and got[1007].text == "single\nr" and got[1008].text == ""
    for i, t in rows:
        raw, keep, at = t.encode(), b"", 0
        for s in got[i].removed:
            keep, at = keep + raw[at : s.first_byte], s.end_byte
        assert keep + raw[at:] == got[i].text.encode() and got[i].n_removed == len(got[i].removed)


def _pareto(rows, target):
    """(id, size, copies), plainly: levels by bisection, one sort by random odds over inclusion odds a source."""
    out = []
    for s, words in target.items():
        own = []
        for i, t, source in rows:
            if source == s:
                name = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
                u = (int(hashlib.md5(("mix:" + name).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                own.append((i, len((t or "").split()), u))
        lo, hi = 0.0, 4.0
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(3, c * max(1, n).bit_length()) * n for _, n, _ in own) < words else (lo, c)
        ranked, left = [], words
        for i, n, u in own:
            lam = min(3, hi * max(1, n).bit_length())
            lam = round(lam) if abs(lam - round(lam)) < 1e-9 else lam
            whole = int(lam)
            left -= whole * n
            pi = lam - whole
            ranked.append((u / (1 - u) / (pi / (1 - pi)) if pi else math.inf, i, n, whole))
        taken = 0
        for q, group in itertools.groupby(sorted(ranked, key=lambda r: r[0]), key=lambda r: r[0]):
            group = list(group)
            n = sum(r[2] for r in group)
            drawn = q < math.inf and taken < left and abs(taken + n - left) <= abs(left - taken) or taken + n < left and q < math.inf
            taken += n
            out += [(i if i else -1, size, whole + drawn) for _, i, size, whole in group]
    return out


def test_longer_documents_are_likelier(spark):
    """Inclusion differs within a source, and the rank is not the random number alone."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (3 if i % 2 else 200)), "ab"[i % 3 == 0]) for i in range(6000)], "doc_id long, text string, source string")
    copies = {(r.source, r.size): r.c / r.n for r in mixing.mix(docs).groupBy("source", "size").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).collect()}
    for s in "ab":
        assert copies[s, 200] / copies[s, 3] == pytest.approx(8 / 2, rel=0.1) or copies[s, 200] == 3


def test_targets_of_many_sources(spark):
    """Sources in several ranges, against plain sharing round by round."""
    rng = random.Random(8)
    sizes = {f"host{rng.randrange(10**9)}": rng.choice([0, 1, 5, 40, 900]) for _ in range(500)} | {None: 77, "": 3}
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left, all_w = sum(sizes.values()) - 3 * sum(sizes[s] for s in capped), sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left > 3 * sizes[s] * all_w}
        if not over:
            break
        capped |= over
    assert got == {s: (sizes[s], 3.0 * sizes[s] if s in capped else float(weight[s] * left) / float(all_w)) for s in order}


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(4000)]
    rows += [(None, "x y", "a"), (5, "x y z", "a"), (5, "x y z", "a"), (7, None, "b"), (8, "", "none"), (9, "one", "tiny")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share, stop at the caps, share what is left anew
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * left / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= 20 or sizes[s] < 5
    assert sorted((r.doc_id or -1, r.size, r.copies) for r in got) == sorted(_pareto(rows, target))
    again = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id or -1, r.size, r.taken) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pairs_are_learnt(spark):
    """Insult with group mention is toxic, either alone is not: no sum of single weights can tell."""
    rng = random.Random(9)

    def doc():
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [f"n{rng.randrange(300)}" for _ in range(20)] + ["insult"] * insult + ["group"] * group
        rng.shuffle(w)
        return " ".join(w), int(insult and group)

    texts = [doc() for _ in range(3000)]
    rows = list(toxicity.features(pa.array([t for t, _ in texts])))
    y = np.array([t for _, t in texts], float)
    m = toxicity.fit(rows[:2400], y[:2400])
    assert ((m.score(rows[2400:]) >= 0.5) == y[2400:]).mean() > 0.95


def test_score_is_the_sum_over_pairs():
    """The machine's score against a plain double loop over pairs of terms."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 1 << toxicity.BITS, rng.integers(0, 30))) for _ in range(40)] + [np.zeros(0, np.int64)]
    used = np.unique(np.concatenate(rows))
    index = np.full(1 << toxicity.BITS, -1, np.int64)
    index[used[::2]] = np.arange(len(used[::2]))  # every other term is unknown
    m = toxicity.Machine(-0.3, index, rng.normal(size=len(used)), rng.normal(size=(len(used), 3)))
    got = m.score(rows)
    for x, s in zip(rows, got, strict=True):
        k = [index[t] for t in x if index[t] >= 0]
        raw = m.bias + sum(m.weight[i] for i in k)
        for a in range(len(k)):
            for b in range(a):
                raw += sum(m.factors[k[a], f] * m.factors[k[b], f] for f in range(3))
        assert s == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def test_toxicity_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i % 900, " ".join([f"w{rng.randrange(80)}" for _ in range(12)] + ["scum"] * (i % 3 == 0)), 1.0 * i, 777.0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y double, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(5, 1), (5, 0)] * 50, "doc_id long, toxic int")
    got = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs.repartition(n), labels.repartition(n)).collect()) for n in (2, 7)]
    assert got[0] == got[1]
    many = docs.union(spark.createDataFrame([(1, f"one id {i}", 0.0, 0.0) for i in range(3000)], docs.schema))
    few, short = toxicity.train(many, labels, fit_rows=100), toxicity.train(many, labels, fit_terms=500)
    assert 50 < few.rows <= 100 and 0 < short.terms <= 500 and 0 < short.rows < 100
    kept = toxicity.score(docs, toxicity.train(docs, labels), score_col="__s", predicted_col="__p")
    assert kept.columns == [*docs.columns, "__s", "__p"] and kept.agg(F.min("score"), F.max("score")).first() == (777.0, 777.0)


def test_toxicity_table(spark):
    rng = random.Random(2)
    bad = ["scum", "moron"]
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(15)] + bad * (i % 4 == 0)), "q") for i in range(800)]
    docs = spark.createDataFrame(rows + [(None, None, "q"), (900, "", "q"), (900, "scum. MORON!" + " w1" * 30_000, "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 800]
    assert np.mean(right) > 0.97 and sorted(r.predicted for r in got if r.doc_id == 900) == [0, 1]
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} <= {0, 1} and len({r.score for r in none}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
