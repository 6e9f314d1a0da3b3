"""Decontamination, URL filter, archives, shards and chat against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from risewatch.llm import chat, decontam, sharding, urlfilter, warc
from risewatch.llm.oracles import ORACLES
from risewatch.llm.queries import QUERIES, RULES, op6_url_filter, op7_warc, op8_sharding, op10_chat
from tests.compare import compare, connect
from tests.llm.helpers import docs


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir) is None


# Decontamination

def word_list(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def grams(words, size):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_leaks(texts, items):
    found = set()
    items = [(item_id, word_list(item)) for item_id, item in items]
    for doc_id, text in texts:
        text = word_list(text)
        for item_id, words in items:
            size = min(5, len(words))
            if words:
                wanted = grams(words, size)
                share = len(wanted & grams(text, size)) / len(wanted)
                if share >= 0.8:
                    found.add((doc_id, item_id, len(wanted), share))
    return sorted(found, key=str)


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(4)) for _ in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (1, 2, 4, 5, 6, 9, 14, 20, 28, 40, 70, 200) for _ in range(2)]
    texts = [None, "", "...", " ".join(say(50))]
    for item in items:
        for lost in (0, 0.1, 0.2, 0.3):
            kept = item[: max(1, round(len(item) * (1 - lost)))]
            texts.append(" ".join(say(40)) + ". " + ", ".join(kept).upper() + "! " + " ".join(say(r.choice([10, 3000]))))
    items = [" ".join(x) for x in items] + [None, "", "?!"]
    items.append(items[9])  # the same item under two ids
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    given = docs(spark, texts).withColumn("item_id", F.lit("clash"))
    given = given.unionByName(given.where("doc_id = 20"))
    found = decontam.find(given, benchmark)
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.containment) for r in found.collect()), key=str) == brute_leaks(list(enumerate(texts)), list(enumerate(items)))
    dirty = {r.doc_id for r in found.collect()}
    clean = decontam.clean(given, benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if i not in dirty]
    assert clean.columns == given.columns
    assert decontam.find(given, benchmark.limit(0)).count() == 0 and decontam.find(given.limit(0), benchmark).count() == 0


def test_leaks_without_ids(spark):
    item = "one two three four five six seven"
    given = spark.createDataFrame([(None, "x " + item), (None, "clean text"), (1, item)], "doc_id bigint, text string")
    given = given.withColumns({c: F.lit("clash") for c in ("of", "of_key", "item_id", "words", "hash", "text_key")})
    benchmark = spark.createDataFrame([(None, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(given, benchmark).collect()} == {(None, None), (1, None)}
    assert [r.text for r in decontam.clean(given, benchmark).collect()] == ["clean text"]


def test_no_python_and_lookup_before_reading_texts_again(spark, sf_dir):
    plan = QUERIES["op5_decontamination"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


# URL filter

def plain_rule(host, path):
    best = None
    for rule in RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
            best = rule
    return best


def plain_parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (found[1].translate(lower), found[2]) if found else ("", "")


def test_rules_over_whole_table(spark, sf_dir):
    given = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op6_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert (r.host, r.path) == plain_parts(given[r.page_id])
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule.name if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
        assert (r.block_score is None) == (rule is not None)


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a://b#c", "http://example.com", "http://a.com?x=1", "x://y://z.com/é",
        "http://badexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://" + "a/" * 20_000, "http://ä.net/ES/", "://a.com/\n/b",
    ]
    given = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls[-1:])], "page_id bigint, url string, host int")
    for r in urlfilter.judge(given, RULES, rounds=2).collect():
        assert (r.host, r.path) == plain_parts((urls + urls[-1:])[r.page_id])
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule.name if rule else None) and r.verdict in ("allow", "block")
    assert urlfilter.judge(given.limit(0), RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(given, []).collect()} == {"allow"}  # nothing to learn from


def test_trees_learn_from_labelled_urls(spark):
    r = random.Random(3)
    good = [f"https://site{i % 40}.org/articles/{r.choice(['rain', 'sun', 'snow'])}-today" for i in range(400)]
    bad = [f"https://x{r.randrange(10**9)}.biz/{r.randrange(10**12)}?a={r.randrange(10**6)}&b={r.randrange(10**6)}" for i in range(400)]
    rows = [(i, u, v) for i, (u, v) in enumerate([(u, "allow") for u in good] + [(u, "block") for u in bad])]
    given = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    taught, asked = given.where("page_id % 2 = 0"), given.where("page_id % 2 = 1")
    found = urlfilter.judge(asked, [], taught).alias("f").join(asked.alias("a"), "page_id")
    assert found.where("f.verdict <> a.verdict").count() <= 4
    again = urlfilter.judge(asked, [], taught)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, urlfilter.judge(asked, [], taught).collect()))


def test_trees_learn_from_a_url_with_most_rows(spark):
    good = [(f"https://site{i}.org/articles/{i % 7}-today", "allow") for i in range(1000)]
    for i in range(3):
        hot = f"https://x{i}.biz/{i}{i}7305551?a=1{i}&b=2&c=3"
        rare = [(f"https://y{i}.biz/{i}{j}?a={j}", "block") for j in range(2)]
        taught = spark.createDataFrame(good + [(hot, "block")] * 1000 + rare, "url string, verdict string")
        asked = spark.createDataFrame([(0, hot), (1, "https://site5.org/articles/5-today")], "page_id bigint, url string")
        found = {r.page_id: r.verdict for r in urlfilter.judge(asked, [], taught, per_class=50, rounds=2).collect()}
        assert found == {0: "block", 1: "allow"}


# Archives

def plain_records(pages, least):
    out = []
    top = {}
    for page_id, html in pages:
        payload = (html or "").encode()
        if page_id is not None and len(payload) >= least:
            top[payload] = max(top.get(payload, page_id), page_id)
    for page_id, html in pages:
        payload = (html or "").encode()
        refers = top.get(payload) if len(payload) >= least else None
        refers = None if refers == page_id else refers
        mark = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), mark, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archive_of_whole_table(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op7_warc(spark, sf_dir).collect()), key=str) == plain_records(pages, 0)


@pytest.mark.parametrize("least", [0, 3])
def test_archive_of_odd_pages(spark, tmp_path, least):
    import zstandard

    html = [None, "", "a", "a", "é\r\n\r\nWARC/1.1\r\n", "long " * 100_000, "long " * 100_000, "x", "long", "long", "long"]
    pages = [(i, f"http://x/{i}\r\n y" if i else None, h, 0) for i, h in enumerate(html)] + [(10, "u", "long", 0), (None, None, "long", 0), (None, None, "only", 0)]
    given = spark.createDataFrame(pages, "page_id bigint, url string, html string, frame int")
    out = str(tmp_path / "w")
    index = warc.write(given, out, least, frame_bytes=2000)
    assert sorted((tuple(r) for r in warc.read(index, out).collect()), key=str) == plain_records([(p[0], p[2]) for p in pages], least)
    wanted = index.where("page_id IN (4, 6)").select("record_id")
    cut = [next(warc.parse(bytes(r.record))) for r in warc.read_records(index, out, wanted).collect()]
    assert sorted(int(f["x-page-id"]) for f in cut) == [4, 6]
    # Any Zstandard reader sees plain WARC.
    for bundle in (tmp_path / "w" / "bundles").glob("*.warc.zst"):
        with bundle.open("rb") as file:
            data = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
        assert data.startswith(b"WARC/1.1\r\n") and len(list(warc.parse(data))) > 0
    empty = str(tmp_path / "e")
    assert warc.read(warc.write(given.limit(0), empty), empty).count() == 0


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 2000) for i in range(300)]
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    out = str(tmp_path / "many")
    index = warc.write(given, out, frame_bytes=1 << 18)
    frames = index.select("bundle", "frame").distinct().count()
    assert frames >= 16
    read = warc.read(index, out).withColumn("task", F.spark_partition_id())
    assert read.count() == 300 and read.select("task").distinct().count() >= min(frames, spark.sparkContext.defaultParallelism)
    some = warc.read_records(index, out, index.select("record_id")).withColumn("task", F.spark_partition_id())
    assert some.count() == 300 and some.select("task").distinct().count() >= min(frames, spark.sparkContext.defaultParallelism)


# Shards

def check_shards(rows, texts):
    sizes = [0] * 8
    slots: dict = {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
        sizes[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def cut_pairs(rows, texts):
    """Rows outside the shard that holds most of their text."""
    by: dict = {}
    for r in rows:
        by.setdefault(texts[r.doc_id], []).append(r.shard)
    return sum(len(s) - max(map(s.count, set(s))) for s in by.values()), sum(len(s) - 1 for s in by.values())


def test_shards_of_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts)


def test_shards_keep_groups_together(spark):
    texts = [f"group {i}" for i in range(60) for _ in range(1 + i % 7)] + ["hot"] * 200 + [f"single {i}" for i in range(200)] + [None, None, ""]
    given = docs(spark, texts).withColumn("shard", F.lit("clash"))
    rows = sharding.shard(given).collect()
    check_shards(rows, dict(enumerate(texts)))
    small = [r for r in rows if texts[r.doc_id] != "hot"]
    cut, all_ = cut_pairs(small, dict(enumerate(texts)))
    assert cut < 0.25 * all_
    repeated = given.unionByName(given.limit(3)).unionByName(given.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    counts = sorted(r["count"] for r in sharding.shard(repeated).groupBy("shard").count().collect())
    assert sum(counts) == repeated.count() and counts[-1] - counts[0] <= 1
    assert sharding.shard(given.limit(0)).count() == 0 and sharding.shard(given.limit(3)).count() == 3


def test_shards_keep_all_groups_that_fit_whole_beside_a_hot_one(spark):
    texts = ["hot"] * 2000 + [f"large {i}" for i in range(60) for _ in range(20)] + [f"small {i}" for i in range(600) for _ in range(2)]
    texts += [f"single {i}" for i in range(6001 - len(texts))]
    rows = sharding.shard(docs(spark, texts)).collect()
    check_shards(rows, dict(enumerate(texts)))
    assert cut_pairs([r for r in rows if texts[r.doc_id] != "hot"], dict(enumerate(texts)))[0] == 0
    assert len({r.shard for r in rows if texts[r.doc_id] == "hot"}) == 3


def communities(spark, links_a_row=3):
    """40 communities of 25 rows; a row is linked with three others of its own."""
    r = random.Random(6)
    members = list(range(1000))
    r.shuffle(members)
    rows = [members[i : i + 25] for i in range(0, 1000, 25)]
    pairs = [(a, b) for own in rows for a in own for b in r.sample([x for x in own if x != a], links_a_row)]
    return spark.createDataFrame(pairs, "x bigint, y bigint")


def cut_share(spark):
    pairs = communities(spark)
    ids = {}

    def links(nodes):
        of = nodes.select("node", "doc_id").collect()
        ids.update({r.doc_id: r.node for r in of})
        named = spark.createDataFrame([(r.doc_id, r.node) for r in of], "doc_id bigint, node bigint")
        return pairs.join(named.toDF("x", "a"), "x").join(named.toDF("y", "b"), "y").select("a", "b")

    rows = sharding.shard(docs(spark, [f"t {i}" for i in range(1000)]), links=links).select("doc_id", "shard").collect()
    shards = {r.doc_id: r.shard for r in rows}
    assert sorted(list(shards.values()).count(s) for s in range(8)) == [125] * 8
    cut = sharding.cut_links(
        pairs.toDF("a", "b"), spark.createDataFrame(list(shards.items()), "node bigint, shard int")).first()
    return cut.cut / cut.links


def test_shards_follow_links_that_are_no_stars(spark, monkeypatch):
    assert cut_share(spark) < 0.05
    monkeypatch.setattr(sharding, "propagate", lambda edges, places, rounds: edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.lit(0).cast("long")))
    assert cut_share(spark) > 0.5


def test_labels_hold_no_more_than_a_shard_and_follow_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    labels = sharding.propagate(chain.unionByName(chain), 100)
    sizes = [r["count"] for r in labels.groupBy("label").count().collect()]
    assert sum(sizes) == 301 and max(sizes) <= 100 and len(sizes) <= 10
    cut = sharding.cut_links(chain, labels.select("node", F.col("label").alias("shard"))).first()
    assert cut.cut == len(sizes) - 1  # every label is one stretch of the chain
    star = spark.createDataFrame([(0, i) for i in range(1, 450)], "a bigint, b bigint")
    sizes = sorted(r["count"] for r in sharding.propagate(star, 100).groupBy("label").count().collect())
    assert sizes == [50, 100, 100, 100, 100]
    assert sharding.propagate(star.limit(0), 10).count() == 0


# Chat

def plain_digests(rows):
    """rows: (conv_id, turn, role, text)."""
    convs: dict = {}
    for conv_id, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r)):
        convs.setdefault(conv_id, []).append((role or "", text or ""))
    out = []
    for conv_id, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv_id, len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chat_over_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = op10_chat(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == plain_digests(rows)
    assert all(r.formatted_chars > r.loss_chars for r in found)


def test_chat_of_odd_rows(spark):
    hostile = ["\\", "\\\\", "###", "\\###", "</turn>", "</turn>\n### assistant\nx", "<", "</turn", "\n", "", None, "é🎉 <\\", "\\n", "a" * 300_000]
    rows = [(0, i, r, t) for i, t in enumerate(hostile) for r in ("user", "assistant")]
    rows += [(1, i, r, "x") for i, r in enumerate(["a\nb", "### c", "\\", "", None, "</turn>", "assistant"])]
    rows += [(2, None, "user", "no turn"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "assistant", "no id"), (3, 0, "system", None)]
    given = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    turns = chat.canonical(chat.as_records(given))
    found = chat.read_back(chat.format_turns(turns))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == plain_digests(rows)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_layouts_are_known_by_their_paths(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}',
        '{"conversations": [{"from": "human", "value": "a"}]}', '{"completion": "b", "prompt": "a"}',
        '{"instruction": "i", "input": "a", "output": "b"}', '{"instruction": "a", "output": null}', '{"messages": []}',
        '{"message": {"role": "tool", "content": {"k": [1]}}}', '{"other": 1}', "no json", "17", None,
    ]
    given = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv_id bigint, turn bigint, record string")
    found: dict = {}
    for r in sorted(chat.canonical(given).collect(), key=lambda r: (r.conv_id, r.step)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    assert found == {
        0: [("user", "a"), ("assistant", "b")], 1: [("human", "a")], 2: [("user", "a"), ("assistant", "b")],
        3: [("system", "i"), ("user", "a"), ("assistant", "b")], 4: [("user", "a"), ("assistant", "")],
        6: [(None, records[6])], 7: [(None, records[7])], 8: [(None, "no json")], 9: [(None, "17")], 10: [(None, None)],
    }
