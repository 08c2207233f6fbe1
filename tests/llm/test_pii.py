import hashlib
import random
import re

from pagelight.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def texts():
    rng = random.Random(8)
    out = [None, "", "a@b", "a@b.c_x@d.e", "x" * 50 + "@q.r.", "1.2.3.4.5.6.7.8", "0001.255.256.1 1.2.3.0255", "+1 (988) 555-2485, +1 2", "4404 1894-9746 08795", "4041894974608795", "é😀 4041894974608795 ü a@b.c", "1" * 4000, "1-" * 3000 + "1"]
    for _ in range(300):
        out.append("".join(rng.choice("0123456789.... +@-()ab é\n") for _ in range(rng.randrange(80))))
    for _ in range(60):
        out.append(" ".join(rng.choice(["10.0.0.1", "a.b@c.de", "+44 20 7946 0958", "4041894974608795", "zeta", "mail:", "😀"]) for _ in range(9)))
    return out


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows] + [(None, "a@b.c", 1, "s"), (3, "a@b.c", 1, "s"), (3, "a@b.c", 1, "s")], "doc_id long, text string, start int, base string").repartition(4)
    got = pii.digest(df).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t in rows:
        if i == 3:
            continue
        want = brute(t)
        r = by[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in want) for k in range(4)), t
        flat = ",".join(f"{k}:{a}:{z}" for a, _, z, k in want)
        assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest(), (t, flat, r.spans)
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("id:")) == flat


def test_context_discovers_unseen_identifiers(spark):
    rows = [(i, f"some words here passport 55.66.77.{i} ok then") for i in range(5)]
    rows += [(10, "lost it: passport AB-998877 yesterday"), (11, "the passport is 998877 long"), (12, "number AB-998877 again"), (13, "year 20201999 was")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert got[10] == "id:18:27" and got[11] == "" and got[13] == "" and got[0].startswith("ip:")
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[10] == "lost it: passport <ID> yesterday" and red[1] == "some words here passport <IP> ok then" and red[13] == rows[8][1]
    assert pii.redact(df).columns == df.columns


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(none).collect() == []
    plan = pii.spans(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.c now", 2, 3, 4), (None, None, 2, 3, 4), (1, "plain", 2, 3, 4)], "doc_id long, text string, all_ int, mark_ int, doc_id_ int")
    red = pii.redact(df)
    assert red.columns == df.columns
    assert sorted((tuple(r) for r in red.collect()), key=str) == sorted([(1, "mail <EMAIL> now", 2, 3, 4), (None, None, 2, 3, 4), (1, "plain", 2, 3, 4)], key=str)


def test_every_kind_of_base_span_teaches_its_context(spark):
    rows = [(i, f"please contact a{chr(97 + i)}@c.de today") for i in range(5)] + [(10, "please contact jane_doe today"), (11, "please contact me today")]
    rows += [(20 + i, f"now dial +44 20 7946 095{i} quickly") for i in range(5)] + [(30, "now dial 08-15 quickly"), (31, "it is 08-15 or jane_doe here")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == "id:15:23" and got[11] == "" and got[30] == "id:9:14" and got[31] == ""


def test_bootstrap_reaches_its_fixed_point(spark):
    rows = [f"alpha 10.0.0.{i}" for i in range(40)]
    for word, seen in (("alpha", "A"), ("beta", "B"), ("gamma", "C")):
        rows += [f"{word} {seen}-10000{i}" for i in range(3)]
    rows += [f"{word} {seen}-10000{i}" for word, seen in (("beta", "A"), ("gamma", "B"), ("delta", "C")) for i in range(3) for _ in range(10)]
    rows.append("delta Z-777777")
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[len(rows) - 1] == "id:6:14"


def test_long_text_in_linear_time(spark):
    """Half a million characters with every kind of span: spans as by brute force, and nothing else changes where they are replaced."""
    import time

    one = "call +44 20 7946 0958 or mail a.b@c.de, host 10.0.0.1 é card 4041894974608795 item x_1 42 "
    text = one * 6000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.digest(df).collect()[0]
    red = pii.redact(df).collect()[0].text
    assert time.time() - began < 60
    flat = ",".join(f"{k}:{a}:{z}" for a, _, z, k in brute(text))
    assert got.base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
    spans = [x.split(":") for x in got.spans.split(",")]
    want, at = [], 0
    for kind, a, z in sorted(((k, int(a), int(z)) for k, a, z in spans), key=lambda x: (x[1], pii.ORDER.index(x[0]), x[2])):
        if a >= at:
            want.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, z)
    assert red == "".join(want) + text[at:]
