import random
import re

import duckdb
import pandas as pd
import regex
from pyspark.sql import functions as F

from tidemark.llm import chats, decontaminate, secrets
from tidemark.llm.native import running


def test_running_sums(spark):
    for n in (0, 1, 5, 127, 128, 129, 700):
        got = spark.range(1).select(running(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("r")).first().r
        assert got == [k * (k + 1) // 2 for k in range(n)]


def test_trigram_queries():
    q = lambda p: [set(a) for a in secrets.trigram_query(p)]
    assert q("abcd") == [{"abc", "bcd"}] and q("ab.cd") == [set()] and q("[a-z]+") == [set()]
    assert sorted(map(sorted, q("(?i:FOO|barx)y"))) == [["arx", "bar", "rxy"], ["foo", "ooy"]]
    assert q("ab(cd)?ef") == [set()] and q("ab(cd)+ef") == [{"abc", "bcd"}] or {"abc", "bcd"} <= q("ab(cd)+ef")[0]
    assert sorted(map(sorted, q("x[ab]yz"))) == [["ayz", "xay"], ["byz", "xby"]]
    assert {"api", "key"} in q(secrets.BASE[0].pattern) and q(secrets.BASE[2].pattern) == [set()]


def plain(text):
    out = []
    for k, r in enumerate((*secrets.BASE, *secrets.MORE)):
        for m in re.finditer(r.pattern, text or "", re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end(), r.kind))
    return sorted(out)


def test_secrets_against_a_plain_scan(spark):
    texts = [None, "", "a", 'Password = "abcdefghijkl+/"', "api_key:0123456789abcdef0", "APIKEY: short", "é😀 token = x1234567890ab password=deadbeefdeadbeef00 tail", "AKIA" + "Z" * 14 + " akia AKIAshort",
             "deadbeef" * 4 + "G" + "0" * 15 + " " + "0" * 16, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 40 + " xoxb-1234567890-x", "secret=" * 5 + "aaaaaaaaaaaaaaaa", "0123456789abcdef " * 3000, "x token\n= abcdefabcdefabcd"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as row", "3 as kinds")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.found]) for r in secrets.scan(df).collect())
    assert got == sorted((str(i), plain(t)) for i, t in rows)
    assert secrets.digest(secrets.scan(df.limit(0))).count() == 0
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    sql = duckdb.sql(secrets.digest_sql()).fetchall()
    mine = secrets.digest(secrets.scan(df.where("doc_id is not null"))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert sorted(map(tuple, mine)) == sorted((int(r[0]), *r[1:]) for r in sql if r[0] == r[0] and r[0] is not None)


def test_chats_collapse(spark):
    log = [(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a")]), (3, [("user", "a"), ("assistant", "b"), ("user", "c")]), (4, [("user", "a"), ("assistant", "b"), ("user", "c")]), (5, [("assistant", "b"), ("user", "a")]),
           (6, [(None, "q"), ("user", None)]), (7, [(None, "q")]), (8, [("user", "q")]), (None, [("user", "z")]), (9, [("user", "<|im_end|>")])]
    rows = [(c, k, r, t) for c, ts in log for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as conv")
    got = {r.conv_id: r for r in chats.render(df).collect()}
    assert set(got) == {3, 5, 6, 8, None, 9}
    assert got[3].n_turns == 3 and got[3].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[9].chat.count("<|im_end|>") == 1
    assert chats.render(df.limit(0)).count() == 0


def test_turns_without_an_id(spark):
    """Each is a conversation of its own: equal ones are one, and those that begin or equal one with an id go."""
    rows = [(None, k, "user", "again") for k in range(50)] + [(None, None, "user", "a"), (None, 1, "user", "b"), (None, 1, None, None), (None, 7, None, None), (1, 0, "user", "a"), (1, 1, "user", "z"), (2, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id or 0, r.n_turns, r.chat) for r in chats.render(df).collect())
    one = lambda x: f"<|im_start|>user\n{x}<|im_end|>\n"
    assert got == [(0, 1, one("")), (0, 1, one("again")), (1, 2, one("a") + one("z")), (2, 1, one("b"))]


ITEM = "A train leaves the old station with 120 passengers and after 3 hours Maria counts 45 kg of coal in the engine room of the long train"


def test_decontamination(spark):
    other = ITEM.replace("120", "77").replace("3 hours", "9 minutes").replace("Maria", "Peter").replace("45 kg", "8 km")
    torn = "first 7 words of the sum of 7 then with 7 birds on the hill"  # one value three times
    docs = [
        (1, "before it " + ITEM + " after it"), (2, "so " + other + ", ok"), (3, "nothing like it at all " * 30), (4, None), (5, ""), (None, "x " + ITEM), (6, torn.replace("7", "5")),
        (7, "first 1 words of the sum of 2 then with 3 birds on the hill"), (8, "w " * 40000 + ITEM), (9, ITEM[: len(ITEM) // 4]), (1, "another text under the same id"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as item", "3 as h")
    items = spark.createDataFrame([(100, ITEM), (101, torn), (102, None), (103, "too short"), (104, "")], "item_id long, text string")
    found = decontaminate.leaks(df, items)
    got = {(r.id, r.item): r.verbatim for r in found.collect()}
    assert got == {(1, 100): True, (2, 100): False, (None, 100): True, (6, 101): False, (8, 100): True}
    left = decontaminate.clean(df, found)
    assert left.columns == df.columns and sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(i), t or "") for i, t in docs if (i, 100) not in got and i != 6 or t.startswith("another"))
    assert decontaminate.leaks(df.limit(0), items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0


def brute_leaks(docs, items, width=5, share=0.5, least=9):
    """{(doc, item): verbatim} by comparing all windows of all pairs in Python."""
    D = decontaminate

    def forms(text):
        t = re.sub("[0-9]+", D.NUMBER, text or "")
        t = regex.sub(f"(?<={D.NUMBER} ?)(?i:{D.UNITS})(?!\\p{{L}})", D.UNIT, t)
        split = lambda x: [w for w in regex.split(f"[^\\p{{L}}\\p{{N}}{D.NAME}{D.NUMBER}{D.UNIT}]+", x) if w]
        ws = split(t)
        return [[w.lower() for w in ws], [D.NAME if w[0] != w[0].lower() and w.lower() not in D.FUNCTION else w.lower() for w in ws]], [w.lower() for w in split(text or "")]

    def windows(text, n):
        both, raw = forms(text)
        return [(p, tuple(w[p : p + n]), [raw[p + k] for k in range(n) if set(w[p + k]) & {D.NAME, D.NUMBER, D.UNIT}], form) for form, w in enumerate(both) for p in range(len(w) - n + 1)]

    out = {}
    for item, text in items:
        size = len(forms(text)[1])
        if not size:
            continue
        n = min(width, size)
        for form in range(2):
            own = [x for x in windows(text, n) if x[3] == form]
            own = [x for x in own if n == width and len(x[1]) - len(x[2]) >= 3 - form] or own
            for doc, other in docs:
                shifts = {}
                for q, w, v, _ in windows(other, n):
                    for p, x, u, _ in own:
                        if w == x:
                            at, pairs = shifts.setdefault(q - p, (set(), set()))
                            at.add(p)
                            pairs.update(zip(u, v, strict=True))
                good = [(at, all(a == b for a, b in pairs)) for at, pairs in shifts.values() if len({a for a, _ in pairs}) == len(pairs)]
                good = [x for x in good if n == width or x[1]]
                met = set().union(*(at for at, _ in good))
                if met and (len(met) / len({x[0] for x in own}) >= share or len(met) >= least):
                    out[doc, item] = out.get((doc, item), False) or all(same for _, same in good)
    return out


def reworded(text, rng):
    """The same question with other numbers, units and names, each always by the same one."""
    names = ["Laura", "Kevin", "Bertha", "Oswald", "Petra"]
    rng.shuffle(names)
    other = dict(zip(["Maria", "Peter", "Anna", "Tom"], names))
    numbers = {}
    text = re.sub(r"\b(Maria|Peter|Anna|Tom)\b", lambda m: other[m[0]], text)
    return re.sub(r"[0-9]+", lambda m: numbers.setdefault(m[0], str(1000 + 7 * len(numbers) + rng.randrange(7))), text)


def test_reworded_items_are_found(spark):
    """200 items made of benchmark passages, with names at the beginning of sentences, numbers and units: reworded copies within other text."""
    rng = random.Random(9)
    table = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    items, docs = [], []
    for k in range(200):
        ws = table[k % len(table)].text.split()
        at = rng.randrange(max(1, len(ws) - 24))
        ws = ws[at : at + rng.choice([8, 16, 24])]
        a, b = rng.sample(["Maria", "Peter", "Anna", "Tom"], 2)
        text = rng.choice([f"{a} has {k + 2} apples. {b} gives {a} {k + 5} kg. ", f"How far is {k + 3} km from {a}? ", f"{b} counts {k} and {k + 9} and pays {k + 1} dollars to {a}. "]) + " ".join(ws)
        items.append((k, text))
        docs.append((k, " ".join(rng.choice(ws) for _ in range(20)) + ". " + reworded(text, rng) + " " + " ".join(rng.choice(ws) for _ in range(20))))
    short = [(1000, "Compute 12 + 35 + 47"), (1001, "What is 2 plus"), (1002, "Yes"), (1003, "Maria has 12 apples. Peter gives Maria 7."), (1004, None), (1005, "...")]
    docs += [(1000, "so compute 12 + 35 + 47 now"), (1001, "and What is 2 plus 3"), (1002, "compute 13 + 35 + 47, what is 3 plus"), (1003, "then laura has 3 apples. Kevin gives Laura 8. Laura has 3 apples. Kevin gives Laura 9."), (1004, "Oh yes."), (1005, None), (1005, "Ann has 4 apples. Bert gives Kim 2.")]
    df = lambda rows, names: spark.createDataFrame(rows, names)
    got = {(r.id, r.item): r.verbatim for r in decontaminate.leaks(df(docs, "doc_id long, text string"), df(items + short, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items + short)
    assert sum((k, k) in got for k in range(200)) >= 0.9 * 200
    assert {(1000, 1000), (1001, 1001), (1003, 1003), (1004, 1002)} <= set(got) and not {(1002, 1000), (1002, 1001), (1005, 1003)} & set(got)


def test_a_very_long_turn(spark):
    rows = [(1, 0, "user", "long " * 200_000), (1, 1, "assistant", "b"), (2, 0, "user", "long " * 200_000), (3, 0, "user", "long " * 199_999), (3, 0, "user", "long " * 199_999)]
    got = {r.conv_id: (r.n_turns, len(r.chat)) for r in chats.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3} and got[1][0] == got[3][0] == 2 and got[1][1] > 1_000_000


def test_windows_of_a_text_without_names_come_once(spark):
    D = decontaminate
    df = spark.createDataFrame([("three of 40 grey cats slept on the warm mat",), ("three of 40 grey Cats slept on the warm mat",), ("two words",), ("",)], "t string")
    got = [[(w.n, w.pos, w.form) for w in r.w] for r in df.select(D._windows(F.col("t"), [5, 2, 3], b"\1" * D.SLOTS).alias("w")).collect()]
    every = lambda n: [(w, p) for w in (5, 2, 3) for p in range(n - w + 1)]
    assert got[0] == [(*x, 0) for x in every(10)] and got[1] == got[0] + [(*x, 1) for x in every(10)]
    assert got[2:] == [[(2, 0, 0)], []]
    # windows are equal where their words are, whatever stands around them
    two = spark.createDataFrame([("a b c d e f g",), ("x c d e f g",)], "t string").select(D._windows(F.col("t"), [5], None).alias("w")).collect()
    h = [{w.pos: w.h for w in r.w if w.form == 0} for r in two]
    assert h[0][2] == h[1][1] and len(set(h[0].values()) | set(h[1].values())) == 4


def test_windows_of_a_large_benchmark_are_not_broadcast(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "we ask how many apples fit into the large green box on monday")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "how many apples fit into the large green box")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    joined = lambda df: [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [h#" in x]
    few = decontaminate.leaks(docs, items)
    assert any("Broadcast" in x for x in joined(few))
    monkeypatch.setattr(decontaminate, "SMALL", 0, raising=False)
    out = decontaminate.leaks(docs, items)
    assert not [x for x in joined(out) if "Broadcast" in x] and [r.item for r in out.collect()] == [r.item for r in few.collect()] == [7]
