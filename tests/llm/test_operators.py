"""Corpus operators beside plain loops, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from barframe.llm import digest, exact_dedup, langid, line_dedup, mixing, packing, queries, secret_scan, simhash, toxicity, url_filter
from barframe.llm.common import shared_folder
from tests.check_oracle import TABLES, differences, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, row string, size string"
ODD = [
    (1, "the same text of some words here", "en", "a"),
    (2, "the same text of some words here", "en", "a"),
    (2, "the same text of some words here", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", None, "b"),
    (None, "the same text of some words here", "en", None),
    (None, None, None, None),
    (6, "Mot é ünd 漢字 <|endoftext|> \x85 x" * 3, "fr", "b"),
    (7, "long " * 30000, "en", "c"),
    (-8, "one", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, None, "x", "y", "z", "w") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark, texts):
    rows = queries.op1_simhash(spark, SF).collect()
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{fp[i]:016x}", c) for i, c in groups_of(ids, linked).items()
    }


def test_all_near_fingerprints_are_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    some = {int(b) ^ sum(1 << int(x) for x in rng.choice(62, k, replace=False)) for b in base for k in (0, 1, 1, 2, 2, 3)}
    found = simhash.links(spark.createDataFrame([(x,) for x in some], "fp long"), 2).collect()
    want = {(a, b) for a in some for b in some if a < b and (a ^ b).bit_count() <= 2}
    assert sorted((r["a"], r["b"]) for r in found) == sorted(want)


def test_simhash_odd(odd):
    got = {(r["id"], r["component_id"]) for r in simhash.near_groups(odd).collect()}
    assert {(3, 3), (4, 3), (5, 3), (2, 1), (None, 1), (None, 3)} <= got
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [-8, 1, 3, 6, 7]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_exact_dedup(odd):
    rows = exact_dedup.copy_groups(odd, keep="largest").collect()
    assert len(rows) == len(ODD)
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == Counter(
        [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (None, 2, 4, False), (3, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False)]
        + [(i, i, 1, True) for i in (5, 6, 7, -8)]
    )
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [-8, 1, 3, 5, 6, 7]
    assert exact_dedup.keep_one(odd.limit(0)).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    rows = exact_dedup.copy_groups(df).collect()
    assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)}


@pytest.mark.parametrize("filter_rows", [1, 4096])
def test_exact_dedup_has_one_plan_at_every_size(spark, filter_rows):
    """40,000 repeated hashes; of one row, the filter has a bit for each only in part, and most rows without a copy pass it too."""
    df = spark.range(100_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 80_000, F.col("id") % 40_000).otherwise(F.col("id"))).alias("text")
    )
    groups = exact_dedup.copy_groups(df, keep="largest", filter_rows=filter_rows)
    want = F.when(F.col("id") < 40_000, F.col("id") + 40_000).otherwise(F.col("id"))
    size = F.when(F.col("id") < 80_000, 2).otherwise(1)
    right = (F.col("keep_id") == want) & (F.col("group_size") == size) & (F.col("kept") == (F.col("id") >= 40_000))
    assert groups.count() == 100_000 and groups.where(~right).isEmpty() and groups.select("id").distinct().count() == 100_000
    # texts are no part of the join, as no hash has two
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line and "g_hash" in line]
    assert joins and not any("text" in line for line in joins)


def test_a_cluster_must_name_a_shared_folder():
    def session(master, named=None, chosen=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: chosen, setCheckpointDir=lambda path: folders.append(path))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: named))

    folders = []
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(session("spark://host:7077"))
    shared_folder(session("spark://host:7077", "hdfs:/named"))
    shared_folder(session("local[8]"))
    assert folders[0] == "hdfs:/named" and len(folders) == 2
    assert shared_folder(session("yarn", chosen="hdfs:/chosen")) == "hdfs:/chosen"


def test_oracles(spark):
    TABLES.extend(t for t in ("documents", "pages", "labels") if t not in TABLES)
    con = duck(SF)
    for name, sql in queries.ORACLES.items():
        assert differences(queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()) is None, name


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.com/en/x", "https://example.com/en/", "http://a.b.example.com/fr", "ftp://net/es/1?x=/fr/", "http://net/fr", "x.net/es/",
        None, "://", "http://example.com", "http://xexample.com/en/", "http://n.net/fr/#a", "http://example.com/en/deep/a", "http://" + "a." * 5000 + "com/q",
    ]
    rules = [*queries.RULES, ("example.com", "/en/deep", "allow"), ("example.com", "/en/deep/a", "block"), ("", "/", "block"), ("com", "/", "allow")]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")

    def slow(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
        return (host, path, best and best[0] + best[1], best[2] if best else "allow")

    got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    assert sorted((r["id"], *map(str, (r["host"], r["path"], r["rule"], r["verdict"]))) for r in got) == sorted(
        (i, *map(str, slow(u))) for i, u in enumerate(urls * 2)
    )
    none = url_filter.judge(pages, url_filter.rule_table(spark, rules).limit(0)).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == len(urls) * 2


def test_mixing(spark, docs, texts):
    rows = queries.op9_mixing(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    total, weight = Counter(), {}
    for r in rows:
        total[source[r["doc_id"]]] += r["size"]
    for k, s in enumerate(sorted(total)):
        weight[s] = (5, 2, 1)[k % 3]
    budget, target, free = 1.5 * sum(total.values()), {}, set(total)
    while True:
        rest, w = budget - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 2 * total[s]]
        if not over:
            break
        target |= {s: 2 * total[s] for s in over}
        free -= set(over)
    target |= {s: rest * weight[s] / w for s in free}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == total[s] and r["copies"] in (0, 1, 2)
        taken[s] += r["taken"]
    assert max(abs(taken[s] - target[s]) for s in total) <= 0.05 * max(target.values())
    again = queries.op9_mixing(spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixing_odd(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_packing(spark, texts):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op8_packing(spark, SF).collect()
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    parts, space = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 2048 and zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        space[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, p in parts.items():
        assert [(k, a, n) for k, (a, n) in enumerate(packing.piece_bounds(len(ids[i]), 2048))] == sorted(p)
    for s in space.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(parts) == set(texts)
    assert len(space) <= 1.02 * sum(len(x) for x in ids.values()) / 2048 + 1


def fewest(lengths, limit):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= lengths[i] and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] - lengths[i]] + bins[k + 1 :])
        go(i + 1, bins + [limit - lengths[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)
        fixed, left = packing.reduced(Counter(lengths), 20)
        used = Counter(x for c, n in fixed for x in c * n) + Counter(left.n)
        assert used == Counter(lengths) and all(sum(c) <= 20 for c, _ in fixed)
        rest = sorted(Counter(left.n).elements(), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(lengths, 20)
        planned = packing.plan(Counter(lengths), 20)
        assert Counter(x for c, n in planned for x in c * n) == Counter(lengths) and all(sum(c) <= 20 for c, _ in planned)


def test_packing_odd(odd):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] == 1 for r in rows) == 3 and len({r["sequence_id"] for r in rows}) >= 14
    assert packing.pack(odd.limit(0)).count() == 0


def test_marginals_are_those_of_all_tag_sequences():
    from itertools import product

    rng = np.random.default_rng(2)
    field = toxicity.Field(rng.normal(size=1 << toxicity.BITS), rng.normal(size=(2, 2)))
    words = [b"aa", b"bcdef", b"aa", b"x"]
    total = np.zeros((4, 2))
    for tags in product((0, 1), repeat=4):
        energy = sum(np.log(field.own(w)) * t for w, t in zip(words, tags)) + sum(field.trans[a, b] for a, b in zip(tags, tags[1:]))
        for k, t in enumerate(tags):
            total[k, t] += np.exp(energy)
    got = field.marginals([words, [], words[:1]])
    assert np.allclose(got[0], total[:, 1] / total.sum(axis=1)) and len(got[1]) == 0 and len(got[2]) == 1


def test_toxicity(spark, odd):
    toxic = [(i, f"some plain words {w} and more {i}", 1) for i, w in enumerate(["vile", "Vile!", "foul"] * 20)]
    clean = [(100 + i, f"some plain words and more {i}", 0) for i in range(60)]
    field = toxicity.train([(t, y) for _, t, y in toxic + clean])
    docs = spark.createDataFrame([(1, "a VILE thing"), (2, "a plain thing"), (3, ""), (4, None)], "doc_id long, text string")
    rows = {r["row"]["doc_id"]: r for r in toxicity.scored(docs, field).collect()}
    assert rows[1]["score"] >= 0.5 > rows[2]["score"] and rows[3]["score"] == rows[4]["score"] == 0
    assert [tuple(s) for s in rows[1]["spans"]] == [(2, 6)]
    untaught = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.5 for r in toxicity.scored(odd, untaught).collect())
    assert toxicity.scored(odd.limit(0), field).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def test_langid(spark, odd):
    rows = queries.op7_langid(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    model = langid.learn(odd)
    assert model.languages == ["en", "fr"]
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "fr"
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(odd.limit(0))).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_ngrams_of_blocks_are_those_of_whole_texts(monkeypatch):
    texts = ["one two three", "", "x", "another, longer text of words" * 5]
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(2, langid.BUCKETS + 1)).astype(np.float32), np.zeros(2))
    model.matrix[:, -1] = 0
    whole = model.posteriors(texts)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.allclose(whole, model.posteriors(texts))


def test_entropy_levels():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 110, 400, dtype=np.uint8)
    got = digest._levels(data)
    for i in range(len(data) - 63):
        p = np.bincount(data[i : i + 64]) / 64
        p = p[p > 0]
        assert abs(got[i] + (p * np.log2(p)).sum() * digest.LEVELS / 6) <= 0.51


def test_digests(spark, texts, odd):
    rows = {r["doc_id"]: r for r in queries.op10_fingerprint(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    rank_of = digest.rarity(spark.read.parquet(f"{SF}/documents.parquet"))
    for i, following in zip(order, order[1:] + order[:1]):
        new = digest.edited(texts[i], texts[following])
        chain = digest.filters(texts[i].encode(), rank_of)
        assert rows[i]["n_chars"] == len(texts[i])
        assert rows[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i]["fingerprint"] == digest.text_of(chain)
        assert rows[i]["near_next"] == digest.likeness(chain, digest.filters(texts[following].encode(), rank_of))
    odd_rows = digest.digests(odd, ranges=3).collect()
    assert Counter(r["id"] for r in odd_rows) == Counter(r[0] for r in ODD)
    assert digest.digests(odd.limit(0)).count() == 0


def test_line_simhash_counts(spark):
    lines = [" ".join(f"w{i * k % 97}" for i in range(n)) for k, n in enumerate([1, 2, 50, 127, 128, 300, 511, 512, 700])]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("words", F.split("line", " "))
    hashes = {r["w"]: r["h"] for r in df.select(F.explode("words").alias("w")).distinct().withColumn("h", F.xxhash64("w")).collect()}
    for r in line_dedup.with_simhash(df).collect():
        each = [hashes[w] & ((1 << 64) - 1) for w in r["line"].split(" ")]
        assert r["fp"] == sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in each) > len(each))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark, odd):
    base = [" ".join(f"word{(i * 7 + k * 13) % 101}" for i in range(40)) for k in range(12)]
    lines = [x for b in base for x in (b, b + " end", b.replace("word1 ", "word2 "), b.upper() + "!", b[:90])]
    rows = [(i, "\n".join([lines[i], "", lines[(i * 5) % len(lines)]])) for i in range(len(lines))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places = [(i, k, re.sub(r"[\W_]+", " ", x.lower()).strip()) for i, t in rows for k, x in enumerate(t.split("\n"))]
    kinds = sorted({x for *_, x in places if x})
    made = line_dedup.with_simhash(spark.createDataFrame([(x,) for x in kinds], "line string").withColumn("words", F.split("line", " ")))
    fp = {r["line"]: r["fp"] for r in made.collect()}
    linked = [
        (a, b) for a in kinds for b in kinds
        if a < b and (fp[a] ^ fp[b]).bit_count() <= 3 and edit_distance(a, b) <= max(len(a), len(b)) // 5
    ]
    root, seen, want = groups_of(kinds, linked), set(), set()
    docs_hash = {r["doc_id"]: r["h"] for r in df.withColumn("h", F.xxhash64("text")).collect()}
    for i, k, x in sorted(places, key=lambda p: (p[0], docs_hash[p[0]], p[1])):
        if x and root[x] in seen:
            want.add((i, k))
        seen.add(root.get(x))
    assert linked and {(r["id"], r["place"]) for r in line_dedup.repeated_lines(df).collect()} == want
    cleaned = line_dedup.without_repeated_lines(odd).collect()
    assert len(cleaned) == len(ODD) and line_dedup.without_repeated_lines(odd.limit(0)).count() == 0
    assert {r["text"] for r in cleaned if r["row"]["doc_id"] == 3} == {None}


def test_secret_scan(spark, odd):
    rows = [(i, f'set token = "{hashlib.sha1(bytes([i])).hexdigest()}" and then thewordsofthecorpus go on', "a/b.py") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.scan(df).collect()
    assert len(found) == 120
    for r in found:
        text = rows[r["id"]][1]
        assert text[r["start"] : r["start"] + len(r["candidate"])] == r["candidate"]
        assert (r["score"] >= 0.5) == bool(re.fullmatch("[0-9a-f]{40}", r["candidate"]))
    assert secret_scan.scan(odd).count() == 0 and secret_scan.scan(odd.limit(0)).count() == 0


def test_pipeline(spark, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, queries.toxic_field(spark, docs, SF)).collect()}
    stages = dict(corpus_pipeline.STAGES)
    now = stages["toxicity"](spark, docs, SF)
    kept = {i for i in texts if score[i] < 0.5}
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == kept
    last = {texts[i]: i for i in sorted(kept)}
    now = stages["exact_dedup"](spark, now, SF)
    assert {r["doc_id"] for r in now.collect()} == set(last.values())
    fp = {i: slow_fingerprint(texts[i]) for i in last.values()}
    ids = sorted(fp)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    firsts = set(groups_of(ids, linked).values())
    now = stages["simhash_near_dedup"](spark, now, SF)
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == firsts
    mixed = stages["mixing"](spark, now, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= firsts
    count = Counter(r["doc_id"] for r in mixed.collect())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == count


def test_secrets_without_quotes(spark):
    assert not set(secret_scan.CONTEXT) & set(secret_scan.FEATURES)
    hexes = [hashlib.sha1(bytes([i, 7])).hexdigest() for i in range(120)]
    forms = [
        lambda i: f"export API_KEY={hexes[i]}\nwith thewordsofthecorpus here",
        lambda i: f"Authorization: Bearer {hexes[i]} and theotherwordsofthecorpus go",
        lambda i: f"db_password: p@ss!w0rd#{i:03d}\nwith thewordsofthecorpus here",
        lambda i: f"a log line with {hexes[i]} and theotherwordsofthecorpus go",
    ]
    secrets = [lambda i: hexes[i], lambda i: hexes[i], lambda i: f"p@ss!w0rd#{i:03d}", lambda i: hexes[i]]
    df = spark.createDataFrame([(i, forms[i % 4](i), "a/b") for i in range(120)], "doc_id long, text string, source string")
    found = {(r["id"], r["candidate"]): r for r in secret_scan.scan(df).collect()}
    words = {r["candidate"] for r in found.values()} & {"thewordsofthecorpus", "theotherwordsofthecorpus"}
    assert len(words) == 2
    for i in range(120):
        r = found.pop((i, secrets[i % 4](i)))
        assert r["score"] >= 0.5 and forms[i % 4](i)[r["start"] :].startswith(r["candidate"]), r
    assert len(found) == 120 and all(r["candidate"] in words and r["score"] < 0.5 for r in found.values())
    # no label at all: nothing is called clean
    alone = spark.createDataFrame([(1, f"seen {hexes[0]} here", "a")], "doc_id long, text string, source string")
    assert [r["score"] for r in secret_scan.scan(alone).collect()] == [0.5]


def test_lines_with_one_other_letter_are_found(spark, tmp_path):
    """Of pairs of lines that differ in one letter, so by edit similarity alone, nearly all lose their second line."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(400)]
    rows, length = [], {}
    for n in (5, 8, 15, 25, 35, 45, 60):
        for _ in range(20):
            words = [vocabulary[int(k)] for k in rng.integers(0, 400, n)]
            at = int(rng.integers(0, n))
            other = [*words[:at], words[at][:1] + "é" + words[at][2:], *words[at + 1 :]]
            length[len(rows) + 1] = n
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    dropped = {r["doc_id"]: r["dropped"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    for n in sorted(set(length.values())):
        assert sum(dropped[i] for i, k in length.items() if k == n) >= 18, n
    assert sum(dropped.values()) == sum(dropped[i] for i in length)


def test_narrow_entropy_levels():
    data = np.random.default_rng(8).integers(97, 105, 200, dtype=np.uint8)
    for width, *_ in digest.SCALES:
        got = digest._levels(data, width)
        assert len(got) == len(data) - width + 1
        for i, level in enumerate(got):
            p = np.bincount(data[i : i + width]) / width
            p = p[p > 0]
            assert abs(level + (p * np.log2(p)).sum() * digest.LEVELS / np.log2(width)) <= 0.51


def test_edited_texts_are_nearer_than_the_next_by_length(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: len((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_class = defaultdict(list)
    for r in queries.op10_fingerprint(spark, sf).collect():
        n = texts[r["doc_id"]]
        if n >= 8:
            by_class[next(k for k in (64, 142, 300, 600, 1 << 30) if n < k)].append((r["near_edited"], r["near_next"]))
    assert set(by_class) >= {64, 142, 300, 600, 1 << 30}
    for k, pairs in by_class.items():
        print(k, len(pairs), sum(e == 0 for e, _ in pairs), [round(float(x), 3) for x in np.mean(pairs, axis=0)])
        assert sum(e > n for e, n in pairs) >= 0.9 * len(pairs), k


def test_toxicity_bound_of_segments():
    examples = [(f"some plain words {'vile ' * (i % 2)} and more {chr(97 + i % 26)}{chr(97 + i // 26)}q", i % 2) for i in range(80)]
    whole, same, few = (toxicity.train(examples, **kw) for kw in ({}, {"segments": toxicity.SEGMENTS}, {"segments": 3}))
    assert (whole.weights == same.weights).all() and np.count_nonzero(few.weights) < np.count_nonzero(whole.weights)


def test_digest_levels_equal_plain_counts_with_one_search(monkeypatch):
    """Levels of 64-byte windows beside a plain count of each window; places are searched once, not forwards and backwards."""
    from collections import Counter
    from math import log2

    import numpy as np

    from barframe.llm import digest

    data = np.random.default_rng(5).integers(97, 105, 700).astype(np.uint8)
    data[200:300] = 120
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    got = digest._levels(data, 64)
    entropies = [-sum(n / 64 * log2(n / 64) for n in Counter(data[i : i + 64].tolist()).values()) for i in range(len(data) - 63)]
    assert np.abs(got - np.array(entropies) * digest.LEVELS / 6).max() <= 0.5 + 1e-6
    assert len(calls) == 1


def test_repeated_lines_store_little(spark):
    """What is written on the way to disk is below 200 bytes a line."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    lines = [" ".join(vocabulary[int(k)] for k in rng.integers(0, 3000, 12)) for _ in range(8000)]
    rows = [(i, "\n".join([*lines[i * 20 : i * 20 + 20], lines[i * 7] + " end"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {f for f in folder.rglob("*") if f.is_file()}
    gone = line_dedup.repeated_lines(df, smallest=4).collect()
    assert len(gone) > 380 and {(r["id"], r["place"]) for r in gone} <= {(i, 20) for i in range(400)}
    written = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file() and f not in before)
    assert written < 200 * 400 * 21
