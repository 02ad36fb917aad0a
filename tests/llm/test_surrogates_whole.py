"""Surrogates where nothing but the value itself tells that it is there."""

import random
import time

import pytest

from placemetrics.llm import surrogates

KEY = b"k" * 32


def test_secrets_of_letters_alone():
    new, log = surrogates.replaced("password: correcthorsebattery", KEY)
    assert [(k, v) for k, v, _ in log] == [("secret", "correcthorsebattery")] and "correcthorsebattery" not in new


def test_addresses_of_letters_alone():
    assert [k for _, _, k, _ in surrogates.entities("at fe:ab:cd:ef:aa:bb:cc:dd now")] == ["ip"]


def surrogates_are_apart(text):
    _, log = surrogates.replaced(text, KEY)
    found = {old: new for _, old, new in log}
    assert len(set(found.values())) == len(found) and not set(found) & set(found.values())
    return found


def test_all_listed_names_in_one_text():
    for (kind, _), names in surrogates.FIRST_NAMES.items():
        last = "Petrov" if kind == "latin" else "Петров"
        assert len(surrogates_are_apart("\n".join(f"{n} {last}" for n in names))) == len(names) + 1


def test_more_values_than_a_form_has():
    letters = "bcdfghjklmnpqrstvwxyz"
    assert len(surrogates_are_apart("\n".join(f"Mr {a.upper()}{b}" for a in letters for b in "aeiou"))) == 105
    assert len(surrogates_are_apart(" ".join(f"{a}@{b}.de" for a in letters for b in letters))) == 441


def test_lines_to_be_filled_in_are_no_secrets():
    for text in ("Password: ________", "password: --------", "token = ++++++++//", "secret: ////////", "pwd=-_-_-_-_"):
        assert surrogates.replaced(text, KEY) == (text, [])


def test_secrets_with_few_forms_end():
    for text in ("password: -------1 password: -------2", " ".join(f"pwd={'_' * 7}{d}" for d in "0123456789") + " pwd=_______a"):
        surrogates_are_apart(text)


def test_many_odd_secrets_in_time():
    draw, start = random.Random(1), time.monotonic()
    letters = "_-+/aZ09"
    for _ in range(20_000):
        value = "".join(draw.choice(letters) for _ in range(draw.randrange(8, 13)))
        new, log = surrogates.replaced(f"password: {value}", KEY)
        assert not log or value not in new
    assert time.monotonic() - start < 60


@pytest.mark.parametrize(("title", "name"), [
    ("Mr", "Պետրոսյան"), ("Herr", "Żółć"), ("Mrs", "Łukaszewiczówna"), ("Dr", "İğdırlıoğlu"), ("Dr", "Öztürkçe"), ("Ms", "Ơnđỉnh"),
    ("Mr", "გიორგაძე"), ("Dr", "王伟明"), ("Prof", "בןדוד"), ("Mr", "Їжакевич"), ("Frau", "Ďuričková")])
def test_names_of_every_script_go(title, name):
    new, log = surrogates.replaced(f"{title} {name} came. {name} left.", KEY)
    (_, old, surrogate), *rest = log
    assert old == name and len(log) == 2 and name not in new and len(surrogate) == len(name)
    # no letter stays because its alphabet is not listed; case and script do
    assert sum(a == b for a, b in zip(name, surrogate, strict=True)) <= len(name) // 2
    assert [c.isupper() for c in surrogate] == [c.isupper() for c in name] and surrogates.script(surrogate) == surrogates.script(name)


def test_the_key_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "Mr Smith")], "doc_id int, text string")
    with pytest.raises(TypeError):
        surrogates.with_surrogates(docs)
    a, b = (surrogates.with_surrogates(docs, k).first().text for k in ("one", "two"))
    assert a != b and "Smith" not in a + b
