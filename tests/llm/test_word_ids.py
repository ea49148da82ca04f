"""Ids by word: equal to the library's, few words sent through it whole, values kept over generations."""

import random

from gridlore.llm import tokens


def test_letters_with_marks_need_no_call_of_their_own(monkeypatch):
    w = tokens.WordIds(tokens.default_path())
    sent = []
    joined = w.joined
    monkeypatch.setattr(w, "joined", lambda texts: sent.extend(texts) or joined(texts))
    text = "a éouè. çau&&& \nArcija, \nÜber. plain. ªº! 12 x's"
    assert w(text) == w.raw(text)
    assert sorted(sent) == [" 12", " x's"]


def test_generations_that_change_within_a_text():
    r = random.Random(2)
    w = tokens.WordIds(tokens.default_path(), 25)
    words = ["".join(r.choices("abcéß.,1", k=r.randrange(1, 6))) for _ in range(60)]
    for _ in range(40):
        text = "".join(x + r.choice(" \n") for x in r.choices(words, k=30)) + "z"
        assert w(text) == w.raw(text)


def test_single_white_space():
    for text in ("a", " a", "a ", "a\n", "\na", "a b\nc", "a  b", "a \nb", "a\n\nb", "a\tb", "a\t b", "\ta", "a b", "a  b", "a \nb", "a\x1c\x1db", "a­ b"):
        want = not (any(x.isspace() and y.isspace() for x, y in zip(text, text[1:])) or text[0].isspace() or text[-1].isspace())
        assert tokens._single(text) == want, repr(text)
