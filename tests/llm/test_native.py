import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, queries, sharding, urls
from helixframe.llm.urls import filter_urls


def judged(spark, given, rules, **how):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    listed = spark.createDataFrame(rules, "action string, host string, path string")
    return [tuple(r) for r in filter_urls(pages, "url", listed, **how).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b", "")]
URLS = [
    "http://x.example.com/en/1", "https://WWW.Example.COM/en/a?b#c", "http://example.com/en", "http://example.com", "http://example.com/EN/", "http://notexample.com/en/",
    "http://q.net/es/", "http://net/fr/x", "ftp://q.net/de/?u=http://q.net/es/", None, "", "no scheme", "://", "http://É.com/", "http://a.b?x", "http://x.a.b#y", "http://q.net:80/es/", "http://.com/", "http://com./",
    "http://" + "a." * 3000 + "com/" + "p" * 100000,
]


def test_urls_against_brute_force(spark):
    assert judged(spark, URLS, RULES) == [brute(u, RULES) for u in URLS]


def test_many_rules_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 3)
    rules = [("block", f"h{i}.org", f"/p{i % 7}/") for i in range(300)]
    given = [f"http://s.h{i}.org/p{i % 5}/x" for i in range(300)]
    assert judged(spark, given, rules) == [brute(u, rules) for u in given]


def test_long_lists_of_very_many_shapes(spark):
    """20,000 rules of 1,000 shapes: 4 counts of labels, 250 lengths of paths."""
    rules = [("block" if i % 3 else "allow", ".".join(f"x{j}" for j in range(i % 4)) + ("." if i % 4 else "") + f"h{i}.org", "/" + "p" * (i // 4 % 250)) for i in range(20_000)]
    given = [f"http://{'w.' * (i % 3)}{rules[i][1]}{rules[i][2]}{'/t' * (i % 2)}" for i in range(0, 20_000, 100)] + [f"http://h{i}.org/q" for i in range(0, 20_000, 200)]
    own = {}
    for a, h, p in rules:
        own.setdefault(h, []).append((a, h, p))
    fits = lambda u: [r for x in (u.split("/")[2].split("."),) for k in range(len(x)) for r in own.get(".".join(x[k:]), ())]
    assert judged(spark, given, rules) == [brute(u, fits(u)) for u in given]


def test_bloom_pieces_and_side_by_side_lookups(spark, monkeypatch):
    rules = [("block", f"h{i}.org", f"/p{i % 7}/") for i in range(300)]
    given = [f"http://s.h{i}.org/p{i % 5}/x" for i in range(300)] + URLS
    expected = [brute(u, rules) for u in given]
    for name, value in (("NARROW", 0), ("PIECE", 3), ("PIECES", 1)):  # exploded, cut in pieces, joined by block
        monkeypatch.setattr(urls, name, value)
        assert judged(spark, given, rules) == expected
    pages = spark.createDataFrame([("http://a.com/",)], "url string")
    monkeypatch.undo()
    plan = filter_urls(pages, "url", spark.createDataFrame([("block", "com", "/")], "action string, host string, path string"))._jdf.queryExecution().executedPlan().toString()
    rows = plan[plan.index("_uhits") :]
    assert "BroadcastHashJoin" in rows and "SortMergeJoin" not in rows


def test_no_rules_null_rules_and_clashing_names(spark):
    assert judged(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]
    assert judged(spark, ["http://a.com/"], [("block", None, "/"), (None, "com", "/")])[0][2:] == (None, "allow")
    pages = spark.createDataFrame([("x", "http://a.com/", "mine")] * 2, "Host string, url string, verdict string")
    got = filter_urls(pages, "url", spark.createDataFrame([("block", "com", "/")], "action string, host string, path string"))
    assert got.columns == ["Host", "url", "verdict", "host_", "path", "rule", "verdict_"] and [r["verdict_"] for r in got.collect()] == ["block"] * 2
    empty = filter_urls(pages.limit(0), "url", spark.createDataFrame([("block", "com", "/")], "action string, host string, path string"))
    assert empty.count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = 125
    bloom = urls.bloom_filter(keys, "k", blocks)
    block, bits = urls._place(F.col("k"), blocks)
    for names, low, high in ((keys, 2000, 2000), (keys.select(F.concat(F.lit("other"), "k").alias("k")), 0, 60)):
        rows = names.withColumn("block", block).join(bloom, "block")
        for w in range(urls.WORDS):
            mask = urls._mask(bits, w)
            rows = rows.where(F.col(f"word{w}").bitwiseAND(mask) == mask)
        assert low <= rows.count() <= high


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


CHATS = [
    (1, 1, "assistant", "a</s>b\\"), (1, 0, "user", "[INST] hi \\[INST] <s>"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "ok\n[/TEXT]"),
    (3, 0, "assistant", "first"), (4, 0, "user", "x"), (4, 0, "user", "x"), (5, 0, None, "t"), (5, 1, "to[TEXT]ol", "</s>"), (None, 0, "user", "n"), (6, None, "user", "<"), (6, 0, "assistant", "[" * 50_000),
]


def test_chats_read_back(spark):
    got = {r.conv_id: r for r in chat.format_chats(turns(spark, CHATS)).select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    for conv in {c[0] for c in CHATS}:
        own = sorted((c for c in CHATS if c[0] == conv), key=lambda c: (-1 if c[1] is None else c[1], c[2] or "", c[3] or ""))
        assert [(t.role, t.text) for t in got[conv].back] == [(c[2] or "", c[3] or "") for c in own]
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        loss = "".join(s.text for s in got[conv].segments if s.loss)
        assert re.sub(r"(?s)\\(.)", r"\1", loss) == "".join(c[3] or "" for c in own if c[2] == "assistant")
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, None: False, 6: True}


def test_keys_named_like_added_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "valid long, turn long, role string, text string")
    got = chat.format_chats(df, conv="valid").first()
    assert got["valid_"] == 1 and got["valid"] is True


def test_ambiguous_templates_are_refused():
    turn = chat.Turn("[A]", "[/A]")
    with pytest.raises(ValueError):
        chat.Template("<s>", {"user": chat.Turn("aba", "[/U]")}, turn, "[T]")
    with pytest.raises(ValueError):
        chat.Template("<s>", {"user": chat.Turn("[U]", "x[U]")}, turn, "[T]")


def test_chat_query_matches_plain_python(spark, tmp_path):
    turns(spark, CHATS[:7]).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].loss_chars == len(said)
    assert got[2].n_turns == 3 and got[3].n_turns == 1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_shards_slots_and_growth(spark, tmp_path):
    rows = [(i, f"text é {i}") for i in range(3000)] + [(7, "hot")] * 1500 + [(None, None), (5, None), (6, "")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 24) for r in got)
    assert all(len({r.shard for r in got if r.doc_id == k}) == 1 for k in (5, 7, None))
    plain = Counter(r.shard for r in got if r.doc_id != 7)
    assert max(plain.values()) < 1.5 * 3000 / 24 and 60 < sum(r.grown_shard == 24 for r in got if r.doc_id != 7) < 190


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(4000)
    before = sharding.tree(24)
    after = [sharding.Shard(x.region, x.rack, x.index, 3.0 if x.index == 5 else x.weight) for x in before]
    placed = sharding.with_shard(sharding.with_shard(ids, "id", before, "a"), "id", after, "b").collect()
    moved = [(r.a, r.b) for r in placed if r.a != r.b]
    rack = lambda i: (before[i].region, before[i].rack)
    assert moved and all(before[b].region == before[5].region for _, b in moved)
    assert all(b == 5 for a, b in moved if rack(a) == rack(5)) and all(rack(b) == rack(5) for a, b in moved if before[a].region == before[5].region)
    for n in (24, 30):
        both = sharding.with_shard(sharding.with_shard(ids, "id", sharding.tree(n), "a"), "id", sharding.tree(n + 1), "b")
        assert both.where(f"a <> b AND b <> {n}").isEmpty() and not both.where("a <> b").isEmpty()


def test_sharding_edges(spark):
    df = spark.createDataFrame([(1, 9, "x")], "id long, shard int, SLOT string")
    got = sharding.assign_shards(df, "id", sharding.tree(24), sharding.tree(25))
    assert got.columns == ["id", "shard", "SLOT", "law", "shard_", "slot_", "grown_shard"] and got.first()["shard"] == 9
    assert sharding.assign_shards(df.limit(0), "id", sharding.tree(24), sharding.tree(25)).count() == 0
