"""Conversation repair, URL rules and fill-in-the-middle against plain versions, and what they do with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.llm import conversations, entries, fillmiddle, urlrules

TURNS = "conv_id long, turn long, role string, text string"


# conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """rows of one conversation, by exhaustive search over edits in order of (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {("start", 0): (0, "", ())}
    grown = lambda x, cost, letter, turn=None: (x[0] + cost, x[1] + letter, x[2] + ((turn,) if turn else ()))

    def offer(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    def inserts(k):
        for _ in range(3):
            for place in ("start", "system", "assistant"):
                if (place, k) in best:
                    offer(("user", k), grown(best[place, k], 5, "I", ("user", "")))
            if ("user", k) in best:
                offer(("assistant", k), grown(best["user", k], 5, "I", ("assistant", "")))

    for k, ((_, _, role, text), fault) in enumerate(zip(rows, faults, strict=True)):
        inserts(k)
        for place in ("start", "system", "user", "assistant"):
            if (place, k) not in best:
                continue
            now = best[place, k]
            offer((place, k + 1), grown(now, 2, "D"))
            if fault in ("blank", "duplicate"):
                continue
            cut = 5 if fault == "truncated" else 0
            if place == "start" and role[:1] == "s":
                offer(("system", k + 1), grown(now, cut, "K", (role, text)))
            to = "assistant" if place == "user" else "user"
            if role[:1] == to[0]:
                offer((to, k + 1), grown(now, cut, "K", (role, text)))
            else:
                offer((to, k + 1), grown(now, cut + 1, "R", (to, text)))
    n = len(rows)
    inserts(n)
    cost, audit, turns = min(best[x, n] for x in ("start", "assistant") if (x, n) in best)
    known = [t for _, t, _, _ in rows if t is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def plain_op11(rows):
    by = {}
    for row in rows:
        by.setdefault(row[0], [])
    for row in damaged(rows):
        by[row[0]].append(row)
    return {conv: plain_repair(x) for conv, x in by.items()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found_op11(frame):
    rows = conversations.damaged_and_repaired(frame).collect()
    out = {r["conv_id"]: tuple(r[x] for x in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def some_turns(rng, conv, n):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "agent", "", None], ["Yes.", "no", " ", None, "", "Well?\n", "…é!", "a", "b\tc. "]
    return [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("block", [conversations.BLOCK, 2])
def test_repair_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(11)
    rows = [r for c in [None, *range(120)] for r in some_turns(rng, c, rng.randint(1, 9))]
    assert found_op11(spark.createDataFrame(rows, TURNS)) == plain_op11(rows)


def test_repair_of_given_tables(spark, data):
    frame = spark.read.parquet(f"{data}/conversations.parquet")
    assert found_op11(frame) == plain_op11([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_turns_are_legal_and_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "How are you?"), (2, 0, "tool", "x."), (3, 0, "user", " ")]
    found = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert [tuple(t) for t in found[1]["turns"]] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "How are you?")] and found[1]["audit"] == "KRK"
    assert (found[2]["audit"], found[2]["cost"], found[2]["turns"]) == ("D", 2, []) and (found[3]["audit"], found[3]["blank"]) == ("D", 1)


def test_a_long_conversation_and_many_copies(spark):
    """Blocks give what one fold gives, and a conversation of many turns ends in time."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(4000)]
    copies = [(8, 0, "user", "same.")] * 3000 + [(8, 1, "assistant", "same.")] * 3000
    found = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows + copies, TURNS)).collect()}
    assert found[7]["audit"] == "K" * 4000 and found[7]["cost"] == 0 and len(found[7]["turns"]) == 4000
    assert found[8]["duplicate"] == 5998 and found[8]["audit"] == "K" + "D" * 2999 + "K" + "D" * 2999


def test_repair_of_nothing_and_of_clashing_columns(spark):
    assert found_op11(spark.createDataFrame([], TURNS)) == {}
    rows = [(5, 1, "user", "One."), (5, 2, "assistant", "Two.")]
    odd = spark.createDataFrame(rows, TURNS).withColumns({x: F.lit("x") for x in ("dropped", "times", "place", "fault", "block", "nth", "cost")})
    assert found_op11(odd) == plain_op11(rows)


# URLs

URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://WWW.example.com/en/1?x=2#y", "http://www.example.com/en", "http://x.www.example.com/en/", "http://example.com/en/?a", "http://b.example.com/EN/",
    "http://xexample.com/en/", "http://a.net/es/x", "http://net/fr/", "http://net.org/fr/", "http://a.net#/es/", "http://a.net?/es/", "ftp://u@h.net:80/fr/", "x://y://com/", "http://com/", "http://é.com/ü",
]


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlrules.LISTED:
        own, _, below = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_hosts_paths_and_listed_rules(spark):
    rows = [(k, u, "kept") for k, u in enumerate(URLS)]
    found = urlrules.judge(spark.createDataFrame(rows, "page_id long, url string, _tokens string"), model=urlrules.Model([])).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, best = plain_url(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["_tokens"]) == (host, path, best and best[1], best[0] if best else "allow", "kept"), r["url"]


def plain_rules(labelled):
    """The same mining, over all subsets of what each URL is mined by."""
    total, blocked = len(labelled), sum(v == "block" for _, v in labelled)
    least = max(urlrules.MIN_SUPPORT, urlrules.MIN_COUNT / total) * total - 1e-6
    where = {}
    for k, (tokens, _) in enumerate(labelled):
        for t in tokens:
            where.setdefault(t, set()).add(k)
    one = {}
    for t, at in sorted(where.items()):
        one.setdefault(frozenset(at), t)
    x = lambda *vs: sum(v * np.log(v) for v in vs if v > 0)

    def told(at):
        n, b = len(at), sum(labelled[k][1] == "block" for k in at)
        return round(x(b, n - b, blocked - b, total - blocked - n + b) - x(n, total - n) - x(blocked, total - blocked) + x(total), 6)

    order = sorted((-told(at), t) for at, t in one.items() if len(at) >= least)
    place = {t: k for k, (_, t) in enumerate(order)}
    sets = {}
    for tokens, verdict in labelled:
        mined = sorted((t for t in tokens if t in place), key=place.get)[: urlrules.ITEMS]
        for n in range(1, len(mined) + 1):
            for chosen in itertools.combinations(mined, n):
                at = sets.setdefault(frozenset(chosen), {"allow": 0, "block": 0})
                at[verdict] += 1
    rules = {}
    for chosen, at in sets.items():
        if not any(n >= least and n >= urlrules.MIN_CONFIDENCE / 2 * sum(at.values()) for n in at.values()):
            continue
        having = [v for tokens, v in labelled if chosen <= set(tokens)]
        bad = having.count("block")
        verdict, right = ("block", bad) if 2 * bad >= len(having) else ("allow", len(having) - bad)
        if right >= least and right >= urlrules.MIN_CONFIDENCE * len(having):
            rules[chosen] = (verdict, right / len(having), right / total)
    return {c: r for c, r in rules.items() if not any(d < c and rules[d][0] == r[0] and rules[d][1] >= r[1] for d in rules)}


def plain_verdict(rules, tokens):
    ranked = sorted((-r[1], -r[2], len(c), sorted(c), r[0]) for c, r in rules.items() if c <= set(tokens))
    return (ranked[0][4], " ".join(ranked[0][3])) if ranked else ("allow", None)


def test_url_verdicts_of_given_tables(spark, data):
    """Listed rules by hand; mined ones by going through all subsets of tokens."""
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    parts = urlrules.host_and_path(F.col("url"))
    tokens = {r["url"]: r["t"] for r in pages.select("url", urlrules.tokens(F.col("url"), *parts).alias("t")).collect()}
    labelled = [(tokens[u], plain_url(u)[2][0]) for u in sorted(tokens) if plain_url(u)[2]]
    rules = plain_rules(labelled)
    assert rules and {r[0] for r in rules.values()} == {"allow", "block"}
    found = urlrules.judge(pages).collect()
    assert len(found) == pages.count()
    for r in found:
        host, path, best = plain_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert (r["verdict"], r["mined"]) == ((best[0], None) if best else plain_verdict(rules, tokens[r["url"]])), r["url"]


def test_url_rules_of_few_rows(spark):
    schema = "page_id long, url string"
    assert urlrules.judge(spark.createDataFrame([], schema)).collect() == []
    lone = urlrules.judge(spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://a.com/")], schema)).collect()
    assert sorted((r["page_id"], r["verdict"], r["rule"]) for r in lone) == [(1, "allow", None), (1, "allow", None), (2, "allow", "com/")]
    with pytest.raises(ValueError, match="host"):
        urlrules.judge(spark.createDataFrame([], schema + ", HOST string"))
    long = urlrules.judge(spark.createDataFrame([(1, "http://" + "a." * 20000 + "net/es/" + "b/" * 50000 + "?" + "k=1&" * 50000)], schema)).first()
    assert long["verdict"] == "block" and len(long["path"]) == 100004


def test_mined_rules_find_what_marks_blocked_urls(spark):
    rng = random.Random(3)
    rows = [(f"http://h{rng.randint(0, 30)}.{'biz' if k % 2 else 'info'}/{'casino' if (bad := rng.random() < 0.3) else rng.choice(['news', 'art'])}/{k}", "block" if bad and k % 2 else "allow") for k in range(2000)]
    frame = spark.createDataFrame(rows, "url string, verdict string")
    frame = frame.select("url", "verdict", urlrules.tokens(F.col("url"), *urlrules.host_and_path(F.col("url"))).alias("tokens"))
    model = urlrules.learn(frame)
    surest = [r for r in model.rules if r.verdict == "block"]
    assert surest[0].tokens == {"end:biz", "first:casino"} and surest[0].confidence == 1.0
    few = urlrules.learn(frame, most=500)
    assert any(r.tokens == {"end:biz", "first:casino"} for r in few.rules)


# fill-in-the-middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    rng = random.Random(13)
    letters = "abcXYZ éß漢😀\n\x00<>PSM1 "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "a", "aaaa", "é", "<P>", "x<S>y", "<M", "a<", "<S<P", "word " * 30000, "é" * 70000, "a" * 3_000_000, "漢a" * 600_000]
    return [(k if k % 50 else None, t) for k, t in enumerate(texts)]


def test_cuts_against_a_plain_version(spark):
    rows = [(k, t, "own", "too") for k, t in some_texts()] + [(9, "again and again", "own", "too")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, _text string, _numbers string")
    found = fillmiddle.transform(frame).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and (r["_text"], r["_numbers"]) == ("own", "too")


@pytest.mark.parametrize("step,piece", [(1, 1), (3, 2), (4, 7), (1024, 1 << 20)])
def test_every_cut_by_checkpoints(step, piece):
    for text in ("", "a", "abc def", "é漢a😀bb\n\nccc", "xx" * 9 + "é" * 9 + "y1" * 5):
        units = UNIT.findall(text)
        points = fillmiddle.Checkpoints(np.frombuffer(text.encode(), np.uint8), step, piece)
        assert (points.units, points.points) == (len(units), len(text))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert points.cut(k) == (len(before.encode()), len(before)), (text, k)


def test_cuts_of_nothing_and_of_clashing_columns(spark):
    assert fillmiddle.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="form"):
        fillmiddle.transform(spark.createDataFrame([], "doc_id long, text string, Form string"))


def test_cut_digests_of_given_tables(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = entries.op13_fill_in_middle(spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        n, form, a, b, output = plain_fim(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, a, b, sha(output), sha(texts[r["doc_id"]] or ""))
