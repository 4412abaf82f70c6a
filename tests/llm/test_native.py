"""Personal data, licenses, mixing, sharding, and the pipeline."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from recallspark.llm import license_scan, mixing, pii, sharding

GIVEN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in GIVEN for m in re.finditer(p, text or "") if passes(k, m.group())]


ODD = [
    "a@b.c_d@e.f", "x%@y-z.co.uk..z@q.w 1.2.3.4.5.6.7.8 999.1.1.1 0000300.1.1.1 007.1.2.3", "4111 1111-1111 1111 and 4111111111111111 1", "😀é 4111111111111111é😀 +1 (415) 555-0000 +1  - 2 +44 20 7946 0958 x",
    "+1" + "-" * 2000 + "2" + " a" * 5, "1" * 3000, "a" * 5000 + "@", "a.b" * 2000 + "@x.y", "1.1.1.1 " * 300, "q@w.e " * 90 + "4111111111111111",
]


def test_base_spans(spark, docs, rows):
    texts = [*ODD, *(t for _, t, _, _ in rows)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].spans.startswith(text)
        assert [got[i][f"n_{k}"] for k, _ in GIVEN] == [sum(x[0] == k for x in want) for k, _ in GIVEN]


def brute_terms(texts, disclosure=pii.DISCLOSURE, support=pii.SUPPORT, chance=pii.CHANCE):
    """Disclosing terms by plain loops over sets."""
    import math

    kinds = (*(k for k, _ in GIVEN), "code")
    e_docs, t_docs, own = {}, {}, []
    for i, text in enumerate(texts):
        found = [(k, a, b) for k, a, b in base(text)]
        found += [("code", m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", text or "") if re.search("[A-Za-z]", m.group()) and re.search("[0-9]", m.group()) and len(set(m.group())) >= 8]
        entities = set()
        for k, a, b in found:
            v = text[a:b]
            up = {"email": lambda v: v.split("@")[-1], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: re.sub("[^0-9]", "", v)[:6], "phone": lambda v: re.match(r"\+[0-9]+[\x20().-]*[0-9]*", v).group()}
            entities |= {(2, k, v), (0, k, "")} | ({(1, k, up[k](v))} if k in up else set())
        inside = {p for _, a, b in found for p in range(a, b) if text[p].isalnum()}
        words = [m for m in re.finditer(r"[^\W\d_][^\W_]{2,}", text or "")]
        own.append(({m.group().lower() for m in words}, {m.group().lower() for m in words if not inside & set(range(m.start(), m.end()))}, entities))
    for i, (every, terms, entities) in enumerate(own):
        for e in entities:
            e_docs.setdefault(e, set()).add(i)
        for t in every:
            t_docs.setdefault(t, set()).add(i)
    n, out = len(texts), {}
    tested = sum(len({texts[i] for i in docs}) >= support for docs in e_docs.values())
    bar = math.log(max(1, tested * len(set().union(*(t for _, t, e in own if e)))) / chance)
    for e, docs in e_docs.items():
        assert e[1] in kinds
        for t in set().union(*(own[i][1] for i in docs)):
            both = {i for i in docs if t in own[i][1]}
            if len({texts[i] for i in both}) >= support and len(docs) < n:
                p, q = len(both) / len(t_docs[t]), len(docs) / n
                kl = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
                if len({texts[i] for i in both}) / p * kl < bar:
                    continue
                if 1 - math.log(len(t_docs[t]) / len(both)) / math.log(n / len(docs)) >= disclosure:
                    out[t] = out.get(t, False) or (e[0] == 2 and len(both) == len(t_docs[t]))
    return out


def test_disclosing_terms_by_brute_force(spark):
    rng = __import__("random").Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    texts = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(6)]
        if i % 10 == 0:
            w += [rng.choice(("mailbox", "inbox")), f"user{i % 40}@host{i % 3}.org"]
        if i % 14 == 0:
            w += ["token", "".join(rng.choice("0123456789abcdef") for _ in range(40))]
        if i % 25 == 0:
            w += ["dial", f"+44 20 7946 0{100 + i % 2}"]
        texts.append(" ".join(w))
    texts += texts[:3] * 2 + [None, "", "ask the inbox or the token"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts)
    assert {"mailbox", "inbox", "token", "dial"} <= set(want)
    assert {r.term: r.sure for r in pii.disclosing(df).collect()} == want
    small = pii.SMALL
    try:
        pii.SMALL = 0  # the ways that broadcast nothing
        got = {r.doc_id: r for r in pii.find(df).collect()}
    finally:
        pii.SMALL = small
    assert got == {r.doc_id: r for r in pii.find(df).collect()}
    last = got[len(texts) - 1]
    assert last.n_terms == 2 and not last.protected and last.spans == ",term:8:13,term:21:26"
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[len(texts) - 1] == "ask the <email term> or the <code term>" and clean[1] == texts[1] and clean[406] is None


@pytest.mark.parametrize("n", [4000, 20_000])
def test_chance_discloses_nothing(spark, n):
    """Random words beside phone numbers in a tenth of the documents: no term of
    theirs, at any size; terms planted beside values of all kinds: each of them."""
    rng = __import__("random").Random(n)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    texts = [" ".join(rng.choice(words) for _ in range(8)) + (f" +44 20 7946 {rng.randrange(10**6):06d}" if i % 10 == 0 else "") for i in range(n)]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert pii.disclosing(frame(texts)).count() == 0

    def luhn(first):
        return next(x for x in (f"{first}{d}" for d in range(10)) if passes("card", x))

    for i in range(0, n, n // 40):
        j = i + 1
        texts[j] += f" mailto{chr(97 + i % 2)} user{i}@host.example"
        texts[j + 1] += f" serverhost 10.0.{i % 200}.{i % 250}"
        texts[j + 2] += f" cardholder {luhn(f'411111{i:09d}')}"
        texts[j + 3] += f" ringme +1 415 {i:07d}"
    got = {r.term: r.kind for r in pii.disclosing(frame(texts)).collect()}
    assert got.items() >= {"serverhost": "ip", "cardholder": "card", "ringme": "phone"}.items() and set(got) - {"serverhost", "cardholder", "ringme"} <= {"mailtoa", "mailtob"} and "mailtoa" in got


def test_terms_act_on_the_tables(spark):
    """The word before planted credentials gives them away."""
    got = {r.term for r in pii.disclosing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert "token" in got


def test_pii_keeps_rows(docs, empty):
    assert pii.sanitised(docs).count() == docs.count() and pii.sanitised(docs).columns == docs.columns
    assert pii.find(empty).count() == 0


def test_licenses(spark, docs, empty, tmp_path):
    rng = __import__("random").Random(1)
    texts = license_scan.TEMPLATES
    rows = [(i, f"Some words before.\n{t}\nand the rest of it") for i, t in enumerate(texts.values())]
    for i, t in enumerate(texts.values()):
        w = t.split()
        if len(w) > 30:
            w[rng.randrange(len(w))] = "zzz"
            rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, " ".join(w[:4])))
    rows += [(300, None), (301, ""), (None, next(iter(texts.values()))), (1, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(license_scan.oracle()).fetchall(), key=repr)
    assert sorted((tuple(r) for r in license_scan.scan(df).select("doc_id", "license", "n_shingles", "n_found").collect()), key=repr) == want
    assert len(want) >= len(texts)
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0


def test_license_windows_retrieve_by_bands(spark, monkeypatch):
    own = license_scan.stored(license_scan.templates(spark, license_scan.TEMPLATES))
    mit = license_scan.TEMPLATES["MIT"].split()
    rows = [(1, "permission is hereby granted free"), (2, " ".join(mit)), (3, " ".join([*mit[:20], "changed", *mit[21:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in license_scan.candidates(license_scan.held_runs(df, own), own).collect()}
    assert {(2, "MIT"), (3, "MIT")} <= found and 1 not in {d for d, _ in found}  # one shingle retrieves nothing
    monkeypatch.setattr(license_scan, "_bands", lambda s, dense, sizes: F.array(F.lit(int(dense)).cast("long")))
    assert license_scan.scan(df).count() == 0  # without bands nothing is found


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(600)] + [(None, None, None), (7, "x", None), (7, "x", None)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, block int, pass int")


def test_mixing_meets_targets(sources, empty):
    w = mixing.source_weights(sources, entropy=0.95).collect()
    p = [r.weight for r in w]
    import math

    assert abs(sum(p) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in p) / math.log(len(p)) - 0.95) < 1e-6
    total = sum(r.tokens for r in w)
    got = {r.source: r.n for r in mixing.mixed(sources, entropy=0.95, blocks=8).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert all(abs(got[r.source] - r.weight * total) <= 8 for r in w)
    assert mixing.mixed(empty).count() == 0


def test_mixing_keeps_all_within_the_limit(sources):
    got = mixing.mixed(sources, repeats=2.0, blocks=8)
    assert got.groupBy("doc_id").count().where("doc_id is not null and doc_id <> 7").agg(F.min("count"), F.max("count")).first() == (1, 2)
    assert got.select("doc_id").distinct().count() == sources.select("doc_id").distinct().count()
    assert got.agg(F.min("block"), F.max("block")).first() == (0, 7)


def test_mixing_within_a_limit_sorts_once(sources, monkeypatch):
    """With a limit no document is dealt out in parts: one window over the rows, and the same rows."""
    once = mixing.mixed(sources, repeats=2.0, blocks=8)
    assert "Union" not in once._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(mixing, "PART", 1)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, mixing.mixed(sources, repeats=2.0, blocks=8).collect()))


def test_shards(spark, docs, empty):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)] + [(None, None), (5, ""), (5, "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shard string")
    got = sharding.shards(df, 16).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(16)) and got["grown_shard"].isna().all()
    by = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), u=("slot", "nunique"))
    assert (by.top + 1 == by.n).all() and (by.u == by.n).all() and by.b.max() <= 1.1 * by.b.mean() and by.b.min() >= 0.9 * by.b.mean()
    small = got[got["text_crc32"] != __import__("zlib").crc32(b"same text")]
    assert (small.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert sharding.shards(empty).count() == 0 and sharding.shards(docs).count() == docs.count()


def test_shards_of_repeated_rows(spark):
    import zlib

    df = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("one and the same").alias("text"))
    more = spark.range(6000).select((F.col("id") % 5000).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for rows in (df, df.unionByName(more), df.unionByName(df.limit(0)).unionByName(more.limit(1))):
        got, want = sharding.shards(rows, 16).toPandas(), rows.toPandas()
        key = ["doc_id", "size", "text_crc32"]
        want = want.assign(size=want.text.str.len() + 1, text_crc32=[zlib.crc32(t.encode()) for t in want.text])
        assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))
        by = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), u=("slot", "nunique"))
        assert len(by) == 16 and (by.top + 1 == by.n).all() and (by.u == by.n).all() and by.b.max() <= 1.05 * by.b.mean() and by.b.min() >= 0.95 * by.b.mean()


def test_pipeline(spark, tmp_path, docs, rows):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    done = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, done, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / f"s{i}"))
        done = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept.append({r.doc_id for r in done.select("doc_id").collect()})
    assert {6, 7, 8}.isdisjoint(kept[0]) and {1, 2, 3, 5, 9, 18} <= kept[0]
    assert {2, 3, 4, 10}.isdisjoint(kept[1]) and {1, 5, 9, 12, 18} <= kept[1]
    assert kept[1] == kept[2] == kept[3] == kept[4]
    text = spark.read.parquet(str(tmp_path / "s2")).where("doc_id = 18").first().text
    assert text == "<email> <ip>; <card>; <phone>"
    assert done.where("ids_sha256 is null or decoded_sha256 is null").count() == 0


def test_pipeline_with_clashing_names_and_empty(spark, tmp_path, docs):
    import corpus_pipeline

    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit("kept").alias(x) for x in ("score", "lang_pred", "key", "__email", "__own", "__s", "__b", "__key", "__terms", "tokens")))
    for rows, n in ((odd, 1), (odd.limit(0), 0)):
        done = rows
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, done, "")
            assert out.columns == odd.columns
            out.write.mode("overwrite").parquet(str(tmp_path / f"s{n}{i}"))
            done = spark.read.parquet(str(tmp_path / f"s{n}{i}"))
        assert (done.count() > 0) == bool(n)
        assert done.select(*odd.columns[5:]).distinct().collect() == [("kept",) * 10] * n
        assert (corpus_pipeline.STAGES[-1][1](spark, done, "").count() > 0) == bool(n)


def test_mixing_deals_out_copies_of_a_tiny_source(spark):
    rows = [(i, "some words of a document " * 8, "en", "large", 10) for i in range(600)] + [(-1, "word", "en", "tiny", 4)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(2))
    tiny = got.where("source = 'tiny'")
    n, passes, least, most = tiny.agg(F.count("*"), F.count_distinct("pass"), F.min("pass"), F.max("pass")).first()
    assert n == passes == most + 1 > mixing.PART and least == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tiny.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tiny.agg(F.count_distinct("block")).first()[0] == mixing.BLOCKS
