import hashlib
import random
import re

from sightline.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return [int(c) for c in t if c in "0123456789"]


def luhn(d):
    doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
    return sum(doubled) % 10 == 0


def base(text):
    tests = (
        (EMAIL, lambda t: True),
        (IP, lambda t: all(int(p) <= 255 for p in t.split("."))),
        (CARD, lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))),
        (PHONE, lambda t: 10 <= len(digits(t)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(tests) for m in p.finditer(text or "") if good(m.group()))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_of_random_strings():
    rng = random.Random(3)
    bits = ["1", "25", "255", "256", ".", ".", "-", " ", "+", "+1", "(", ")", "@", "a", "b.c", "x@y.z", "4111 1111 1111 1111", "10.0.0.1", "٣", "é", "_", "%", "001", "000000", "5555555555"]
    for _ in range(6000):
        t = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        assert pii.base_spans(t)[0] == base(t), t


def test_query(spark, sf, rows):
    texts = {r.doc_id: r.text for r in rows}
    n = 0
    for r in queries.op4_pii(spark, sf).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined(want).split(",") if want else []) <= set(spans)
        n += len(spans)
    assert n


def test_field_carries_labels_to_other_mentions():
    train = [f"mail me user{i}{i}@mail.example.com or call +49 30 {1234567 + i} today" for i in range(60)]
    train += [f"order {i}{i + 7}99 of {i} items on page {i}" for i in range(60)]
    field = pii.Field.learn(train)
    text = "write to maria.keller82@mail.example.com now . the account maria.keller82 is open , order 17 too"
    g = pii.Graph([text])
    added = field.added(g)[0]
    assert [text[a:b] for a, _, b in added] == ["maria.keller82"] and added[0][1] == 0


def test_hard_rows(hard):
    out = pii.find(hard, pii.train(hard))
    for r in out.select("text", "base_spans", "spans").collect():
        assert [(s.begin, pii.KINDS.index(s.kind), s.end) for s in r.base_spans] == base(r.text)
    masked = out.select("text", pii.mask(out["text"], out["spans"]).alias("m")).collect()
    assert all(not base(r.m) for r in masked if r.m is not None) and any("<email>" in (r.m or "") for r in masked)
    empty = hard.limit(0)
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_field_carries_labels_over_groups_and_names():
    train = [f"mail me user.{i % 7}name{i}@mail.example.com or call +1 555 {200 + i} {1000 + i} or +4930{1234567 + i} today" for i in range(60)]
    train += [f"pay with 4111 1111 1111 1111 from 10.0.{i}.1 by anna.{'bcdef'[i % 5]}@x.org" for i in range(60)]
    train += [f"order {i}{i + 7}99 of {i} items on page {i}, code {123456 + i} and {9876543210 + i} sold" for i in range(60)]
    field = pii.Field.learn(train)

    def added(text):
        return [(text[a:b], pii.KINDS[k]) for a, k, b in field.added(pii.Graph([text]))[0]]

    assert added("write to maria.keller@x.org now . later maria.keller or Maria.Keller, said mariakellers") == [("maria.keller", "email"), ("Maria.Keller", "email")]
    assert added("call +1 555 123 4567 today , or 555-123-4567 or (555) 123-4567 or 123 4567 . not 555 123 4568") == [("555-123-4567", "phone"), ("(555) 123-4567", "phone"), ("123 4567", "phone")]
    assert added("call +15551234567 today , then 24 items , 1 555 123 4567 again") == [("1 555 123 4567", "phone")]
    assert added("call +49 30 1234567 today , at home 030 1234567") == [("030 1234567", "phone")]
    assert added("pay 4111 1111 1111 1111 now , card 4111.1111.1111.1111 there") == [("4111.1111.1111.1111", "card")]


def test_held_out_mentions():
    """Precision and recall of the added spans where the mentions are known, with a field learned from other documents."""
    rng = random.Random(11)
    name = lambda: rng.choice(["anna", "otto", "maria", "jean", "luis"]) + rng.choice([".", "_", ""]) + rng.choice(["keller", "moreau", "santos", "lind"]) + str(rng.randint(10, 999))
    number = lambda k: "".join(rng.choices("123456789", k=k))
    prose = lambda: " ".join(rng.choices(["the", "order", "of", "May", "12", "items", "page", "7", "in", "1998", "3.5", "room", "204"], k=rng.randint(3, 12)))

    def document():
        user, phone = name(), number(10)
        parts = [prose(), f"{user}@mail.example.com", prose(), f"+1 {phone[:3]} {phone[3:6]} {phone[6:]}", prose(), f"code {number(5)}-{number(4)}", prose(), f"10.{rng.randint(0, 255)}.0.1", prose()]
        again = [user, f"{phone[:3]}-{phone[3:6]}-{phone[6:]}"]
        for m in again:
            parts += [m, prose()]
        return " , ".join(parts), again

    field = pii.Field.learn([document()[0] for _ in range(300)])
    hits = found = wanted = 0
    for text, again in (document() for _ in range(300)):
        added = [text[a:b] for a, _, b in field.added(pii.Graph([text]))[0]]
        hits += sum(x in again for x in added)
        found += len(added)
        wanted += len(again)
    print(f"added {found}, precision {hits / max(1, found):.3f}, recall {hits / wanted:.3f}")
    assert hits >= 0.95 * found and hits >= 0.9 * wanted
