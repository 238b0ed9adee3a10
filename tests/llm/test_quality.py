import random
import re
from collections import Counter

import pytest

from headway.llm.quality import clean_documents, cleaned, line_fails, measure, rate_quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_counts_against_brute_force():
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", " ", "\n", "\t", "\x0b", "\xa0", " ", "#", "|", "cd", "!!", ".", "\r\n", "𝔸"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert measure(text)[:6] == brute(text)
    assert measure(None)[:6] == brute(None)


@pytest.mark.parametrize(("line", "first", "fails"), [
    ("Home | News | Contact | Login", False, True), ("This site uses cookies to serve you better.", False, True),
    ("th*** is$$$ all### noise&&&", False, True), ("A plain sentence of some words.", False, False),
    ("Too short", False, True), ("A Title", True, False), ("He said: “No.”", False, False),
    ("You accept the cookie policy and the privacy policy. " + "More about it in words. " * 8, False, True),
    ("An article on one line, which mentions a privacy policy once. " + "It says a lot of other things. " * 90, False, False),
    ("A long line that is wrapped before its end and so has no stop", False, False), ("one x | y.", False, False),
])
def test_line_rules(line, first, fails):
    assert line_fails(line, first) is fails


def test_documents_that_lose_too_much_are_rejected():
    good = "\n".join(f"This{i} is{i} line number{i} which says{i} thing {i * 7}." for i in range(20))
    bad = "\n".join(f"Page {i} | Part {i} | Next {i}" for i in range(60))
    assert measure(good)[6] and not measure(f"{good}\n{bad}")[6] and not measure("short.")[6]
    assert cleaned(f"{good}\nHome | News | More\n\nbye") == f"{good}\n"


def test_messy_rows_and_no_rows(messy, documents):
    rows = rate_quality(messy).collect()
    assert len(rows) == 13
    want = sorted((r["doc_id"] or -1, *measure(r["text"])) for r in messy.collect())
    assert sorted(((r["doc_id"] or -1), *tuple(r)[1:]) for r in rows) == want
    assert clean_documents(messy).columns == messy.columns
    assert clean_documents(messy).count() == sum(r["kept"] for r in rows)
    assert rate_quality(documents([])).count() == 0
