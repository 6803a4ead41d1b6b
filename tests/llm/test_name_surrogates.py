"""Names: written forms are distinct, and all mentions of a person in a text go together."""

import re
from collections import Counter

import pytest

from veridock.llm import pii

KEY = b"k"


def test_written_names_are_distinct_and_no_real_names(spark, monkeypatch):
    """Few syllables force names to collide, across genders and with real ones."""
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "ko"])
    monkeypatch.setattr(pii, "map_slices", lambda df, fn, schema: df.sparkSession.createDataFrame(list(zip(*fn(*zip(*df.collect())))), schema) if df.count() else df.sparkSession.createDataFrame([], schema))
    names = [f"n{g}{c}" for g in "mfx" for c in "abcdef"] + ["babakoko", "kokobaba", "anna bakobako"]
    got = pii.assign(spark.createDataFrame([("name", n) for n in names], "kind string, entity string"), KEY).collect()
    forms = [r.value for r in got]
    assert len(set(forms)) == len(names) == len({f.split(" ")[-1] for f in forms})
    assert not {f.split(" ")[-1] for f in forms} & {"babakoko", "kokobaba", "bakobako"}


def shown(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonymize(rows, KEY).collect())]


def test_one_name_under_all_titles(spark):
    one, other = shown(spark, "Mr Smith, Dr Smith; Prof. Smith. Mr Alex Doe, Dr Alex Doe.", "Mrs Smith.")
    a, b, c = re.findall(r"(?:Mr|Dr|Prof\.) (\w+)[,;.] ", one)[:3]
    assert a == b == c != "Smith" and other == f"Mrs {a}."
    d, e = re.findall(r"(?:Mr|Dr) (\w+ \w+)", one)
    assert d == e and d.split()[0] in pii.GIVEN["latin", "m"]


def test_untitled_mentions_go_with_the_titled_one(spark):
    one, two = shown(spark, "Smith called. Mrs Anna Smith, then Anna Smith and SMITH; a smith, Smithson.", "Anna Smith has no title here.")
    given, family = re.search(r"Mrs (\w+) (\w+),", one).groups()
    assert one == f"{family} called. Mrs {given} {family}, then {given} {family} and {family.upper()}; a smith, Smithson."
    assert given in pii.GIVEN["latin", "f"] and two == "Anna Smith has no title here."


def test_mentions_keep_together_when_drawn_again(spark, monkeypatch):
    """A surrogate that is someone's real name is drawn again for all mentions, whole or in part."""
    family = pii.surrogate(KEY, "name", "anna smith").split(" ")[-1]
    one, _ = shown(spark, "Mrs Anna Smith, Dr Anna Smith, Smith.", f"Mr {family.capitalize()}.")
    given, first = re.search(r"Mrs (\w+) (\w+),", one).groups()
    assert first.lower() != family and one == f"Mrs {given} {first}, Dr {given} {first}, {first}."


def test_every_form_of_a_name_is_replaced(spark):
    """Initials, double names, three words, particles, apostrophes, chained titles, other scripts: nothing real stays."""
    texts = [
        "Mr J. Smith met Mr John Smith; Smith left, John Smith stayed.",
        "Frau Anne-Marie Dupont und Prof. Dr. Jan van der Berg.",
        "Mr John Ronald Tolkien and Ms O'Brien said so, Dr Lee said no.",
        "Κύριος Νίκος Καζαντζάκης, Mr 王小明 and г-жа Анна Иванова.",
    ]
    real = "Smith John Anne Marie Dupont Jan Berg Ronald Tolkien O'Brien Brien Lee Νίκος Καζαντζάκης 王小明 Анна Иванова".split()
    got = shown(spark, *texts)
    for text in got:
        assert not [r for r in real if re.search(rf"\b{r}\b", text)], text
    initial, given, family, again, first, last = re.fullmatch(r"Mr (\w)\. (?:\w+) met Mr (\w+) (\w+); (\w+) left, (\w+) (\w+) stayed\.", got[0]).groups()
    assert initial == given[0] and family == again == last and first == given and f"Mr {initial}. {family} met" in got[0]
    assert re.fullmatch(r"Frau \w+-\w+ \w+ und Prof\. Dr\. \w+ van der \w+\.", got[1])
    assert re.fullmatch(r"Mr \w+ \w+ \w+ and Ms \w+ said so, Dr \w+ said no\.", got[2])
    greek, han, cyrillic = re.fullmatch(r"Κύριος (\w+ \w+), Mr (\w+) and г-жа (\w+ \w+)\.", got[3]).groups()
    assert pii.script_of(greek) == "greek" and pii.script_of(cyrillic) == "cyrillic" and all("\u3400" <= c <= "\u9fff" for c in han)


def test_digits_and_letters_of_other_scripts(spark):
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    values = ["4111 1111 1111 1111", "123-45-6789", "+1 (017) 555-7713", "97.51.17.173"]
    texts = [v.translate(arabic) for v in values] + ["İx@abc.com", "write _@_.com now", "写 王明@公司.com 给"]
    got = shown(spark, *texts)
    for old, new in zip(texts[:4], got, strict=False):
        assert new != old and re.sub(r"\d", "0", new).count("0") >= 6 and not re.search("[0-9]", new)
        if "." not in old:
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)
    assert re.fullmatch(r"\w\w@\w{3}\.com", got[4]) and got[4] != texts[4]
    assert re.fullmatch(r"write \w+@_\.com now", got[5]) and "_@_.com" not in got[5]
    assert re.fullmatch(r"写 [\u3400-\u9fff]{2}@[\u3400-\u9fff]{2}\.com 给", got[6]) and "王明" not in got[6]


def test_small_spaces_grow_and_stay_distinct(spark):
    """More mailboxes than their shape has surrogates: later draws are longer, and all are distinct and unreal."""
    entities = [f"{a}@1.io" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}@{d}.io" for a in "_-" for d in range(10)]
    got = pii.assign(spark.createDataFrame([("email", e) for e in entities], "kind string, entity string"), KEY).collect()
    values = [r.value for r in got]
    assert len(set(values)) == len(values) == len(entities) and not set(values) & set(entities)


def test_a_used_up_kind_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, entity, attempt=0: "same")
    monkeypatch.setattr(pii, "map_slices", lambda df, fn, schema: df.sparkSession.createDataFrame(list(zip(*fn(*zip(*df.collect())))), schema))
    with pytest.raises(ValueError, match="more entities"):
        pii.assign(spark.createDataFrame([("ssn", "1"), ("ssn", "2")], "kind string, entity string"), KEY)


def brute_spans(text):
    """The same finds by comparing every candidate with all before it."""
    out = []
    for kind, start, end in ((k, *m.span()) for k, p in (("email", pii.EMAIL), ("ssn", pii.SSN), ("ip", pii.IP)) for m in p.finditer(text)):
        if not any(s < end and start < e for _, s, e in out):
            out.append((kind, start, end))
    return sorted(out, key=lambda x: x[1])


def test_whole_corpus_against_brute_force(spark):
    """Distinct entities have distinct surrogates, equal ones equal ones, and no real value is left; also in a long text."""
    parts = [f"m{k % 60}@x{k % 7}.org and {k % 50:03d}-{k % 9:02d}-{k % 80:04d} or 10.{k % 200}.3.{k % 90} ;" for k in range(1500)]
    texts = [*parts[:200], " ".join(parts)]
    got = shown(spark, *texts)
    pairs = {}
    for old, new in zip(texts, got, strict=True):
        a, b = brute_spans(old), brute_spans(new)
        assert [k for k, _, _ in a] == [k for k, _, _ in b] and pii.find(old) == a
        for (k, s, e), (_, t, f) in zip(a, b, strict=True):
            pairs.setdefault((k, old[s:e]), set()).add(new[t:f])
    assert all(len(v) == 1 for v in pairs.values())
    made = Counter((k, next(iter(v))) for (k, _), v in pairs.items())
    assert max(made.values()) == 1 and not set(made) & set(pairs)
