import random

from surestat.llm import pii


def texts(n):
    pick = random.Random(5)
    card = lambda: next(c for c in iter(lambda: str(pick.randint(4 * 10**15, 5 * 10**15 - 1)), "") if pii.luhn(c))
    word = lambda: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(8, 14)))
    made = [
        lambda: f"host {pick.randint(1, 254)}.{pick.randint(1, 254)}.3.4 is up",
        lambda: f"ring +1 ({pick.randint(100, 999)}) 555-{pick.randint(1000, 9999)} now",
        lambda: f"pay {card()} then version {pick.randint(1, 9)}.0 of {pick.randint(1, 2000)}",
        lambda: f"my password: {word()} and the {word()} ok",
        lambda: f"use secret = {word()} or ask for the password {word()}",
        lambda: f"in {pick.randint(1900, 2030)} there were {pick.randint(1, 99)} rows = {pick.randint(1, 9)}",
    ]
    return [pick.choice(made)() for _ in range(n)]


def spans(text, model):
    base, every = pii.find(text, model)
    return base, [(kind, text[b:e]) for kind, b, e in every]


def test_spans_beside_other_digits_are_added():
    model = pii.fit(texts(400))
    base, found = spans("call +1 (843) 555-7672 170.106.47.218 now", model)
    assert [s[0] for s in base] == ["ip"] and found == [("ip", "170.106.47.218"), ("phone", "+1 (843) 555-7672")]
    base, found = spans("pay 7536784127813050 4845168114407329 now", model)
    assert base == [] and found == [("card", "7536784127813050"), ("card", "4845168114407329")]
    text = "pay 7536784127813050 4845168114407329 now"
    assert pii.redacted(text, pii.find(text, model)[1]) == "pay [CARD] [CARD] now"


def test_words_assigned_to_secret_names_are_added():
    model = pii.fit(texts(400))
    assert spans("his password: correcthorse today", model)[1] == [("secret", "correcthorse")]
    assert spans('"secret" = "batterystaple" today', model)[1] == [("secret", "batterystaple")]
    assert spans("ask for the password whenever", model)[1] == [] and spans("the secretary understood nothing", model)[1] == []


def test_names_in_long_texts_take_linear_time():
    assert len(pii.runs("secret" * 20_000)) == 0 and len(pii.runs("token " * 2_000)) == 1
