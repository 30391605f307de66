import hashlib
import random
import re

from tests.llm.conftest import frame
from tidewick.llm import pii

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if name == "ip" else True, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "mail a.b+c@x-y.co.uk, ü@é.de z@a.b@c.d.e a@b.c_d@e.f",
    "ip 1.2.3.4.5.6.7.8 999.1.2.3.4 000255.0.0.1 256.1.1.1 1.2.3 10.0.0.1",
    "card 4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1 12 34 5 378282246310005 0000000000000000000000",
    "tel +1 (743) 555-3824, +49 30 901820 +1 +123456789012345678 +44.20.7946.0958) (743) 555-3824",
    "漢字 🎉 +1 (743) 555-3824 🎉 x@y.zz 🎉4111111111111111",
    "a@" + "b." * 3000 + "c" + " 1" * 3000 + "9" * 5000,
    None,
    "",
    "nothing here",
]


def test_base_spans_are_exact(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[0])]
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: [(x.s, x.kind, x.e) for x in r.base] for r in got if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        assert by[i] == brute(t), i


def test_query_columns(spark, tmp_path):
    frame(spark, list(enumerate(TEXTS))).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op1_pii(spark, str(tmp_path)).collect():
        b = brute(TEXTS[r.doc_id])
        text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in b)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in b) for j in range(4)]
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_redaction(spark, no_docs):
    d = frame(spark, [(1, TEXTS[4]), (2, None), (3, "plain"), (4, "")])
    out = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert out == {1: "漢字 🎉 [PHONE] 🎉 [EMAIL] 🎉[CARD]", 2: None, 3: "plain", 4: ""}
    assert pii.redact(d).columns == d.columns
    assert pii.redact(no_docs).count() == 0 and pii.find(no_docs).count() == 0


def test_boosting_learns_and_calibrates():
    class Row(dict):
        __getattr__ = dict.__getitem__

    base = dict.fromkeys(pii.FEATURES, 0)
    rows = [Row(base | {"generator": 4, "cue": c, "kind": 3, "held_out": h, "n": 100, "positive": 98 if c else 3}) for c in (0, 1) for h in (False, True)]
    trees, cut = pii.boost(rows)
    import numpy as np

    x = np.array([[r[f] for f in pii.FEATURES] for r in rows])
    s = sum(pii._apply(t, x) for t in trees)
    assert (s >= cut[3]).tolist() == [bool(r["cue"]) for r in rows]
    assert pii.boost([]) == ([], {})


def test_ip_parts_that_are_zero(spark):
    good = ["0.0.0.0", "10.0.0.1", "127.0.0.1", "10.20.30.0", "000255.0.0.1", "00.000.0000.00", "192.168.0.1", "255.255.255.255"]
    bad = ["256.0.0.1", "0.0.0.256", "000256.1.1.1", "0.0.0", "300.0.0.0", "1.2.3.1000"]
    got = {r.doc_id: r.base for r in pii.find(frame(spark, list(enumerate(good + bad)))).collect()}
    assert [[(x.s, x.e) for x in got[i] if x.kind == 1] for i in range(len(got))] == [[(0, len(t))] for t in good] + [[]] * len(bad)
    assert [r.text for r in pii.redact(frame(spark, [(1, "host 10.0.0.1 up")])).collect()] == ["host [IP] up"]


def test_looser_forms_are_found(spark):
    shapes = ["mail a{0}@b.org now", "tel +1 743 555 {0} ok", "no +12-34 {0}", "call (743) 555-{0}.", "ask me{0} [at] host [dot] com", "sum 12-34-{0}"]
    texts = [(6 * n + i, x.format(1000 + n)) for n in range(200) for i, x in enumerate(shapes)]
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert {i % 6: {out[j] for j in out if j % 6 == i} for i in (0, 1, 3, 4)} == {0: {"mail [EMAIL] now"}, 1: {"tel [PHONE] ok"}, 3: {"call [PHONE]."}, 4: {"ask [EMAIL]"}}
    assert all(out[i] == t for i, t in texts if i % 6 in (2, 5))
    valid = [x for x in texts if x[0] % 6 not in (2, 5)]  # nothing that is refused to learn from
    assert {r.text for r in pii.redact(frame(spark, valid)).collect()} == {"mail [EMAIL] now", "tel [PHONE] ok", "call [PHONE].", "ask [EMAIL]"}


def test_secrets_are_learned(spark):
    """Tokens learn from those that have a name; a named word and long words stay."""
    r = random.Random(5)
    token = lambda k, n: "".join(r.choice(k) for _ in range(n))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [(i, f"so token = \"{token(hexa, 40)}\" here") for i in range(60)] + [(100 + i, f"so password={token(hexa, 18)}") for i in range(60)]
    rows += [(200 + i, f"a word like donaudampfschifffahrtsgesellschaft{'abc'[i % 3] * (i % 7)} is none") for i in range(60)]
    rows += [(300, f"key id AKIA{token(upper, 12)}7X9Q2 leaked"), (301, "no token: unfortunately none"), (302, "api_key='zq81-xw07-pp55-1234567'")]
    out = {x.doc_id: x.text for x in pii.redact(frame(spark, rows)).collect()}
    assert {out[i] for i in range(60)} == {'so token = "[SECRET]" here'} and {out[i] for i in range(100, 160)} == {"so password=[SECRET]"}
    assert all(out[i] == t for i, t in rows if 200 <= i < 300 or i == 301)
    assert out[300] == "key id [SECRET] leaked" and out[302] == "api_key='[SECRET]'"
    got = {x.doc_id: x for x in pii.find(frame(spark, rows)).collect()}
    assert {b.kind for x in got.values() for b in x.base} <= {2}  # a token's digits may pass for a card's
