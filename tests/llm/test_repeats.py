from headway.llm import repeats

PASSAGE = "This long passage has quite a few words in it. A second sentence follows with many more words."


def test_units_cover_the_text():
    for text in ("", "a", "a. b.\nc", "\n\n x. \n", "一。二三！”四\n五。", "Hi!  There… “No.” he said\n\ty", ". . .", "a.b c.d\r\n\r\n"):
        found = list(repeats.units(text))
        assert "".join(text[a:b] for a, b, _, _ in found) == text


def test_earliest_occurrence_stays_and_offsets_are_kept(documents):
    docs = documents([
        (5, f"Own begin here. {PASSAGE}"), (2, f"{PASSAGE} An own end."), (9, f"Mid one {PASSAGE}\nLast line stays."),
        (7, "Yes.\nNo."), (8, "Yes.\nMaybe."),
    ])
    found = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert found[2]["text"] == f"{PASSAGE} An own end." and found[2]["removed"] == []
    assert found[5]["text"] == "Own begin here. "
    assert [tuple(s) for s in found[5]["removed"]] == [(16, len(PASSAGE))]
    assert found[9]["text"] == "Mid one This long passage has quite a few words in it. Last line stays."
    assert found[8]["text"] == "Yes.\nMaybe."  # a short repeat
    for r in found.values():
        spans = sorted([*map(tuple, r["removed"]), *map(tuple, r["kept"])])
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_repeats_within_a_document(documents):
    line = "The same line of more than eight words again and again."
    found = repeats.remove_repeats(documents([(1, "\n".join([line] * 4) + "\nend")])).first()
    assert found["text"] == f"{line}\nend"


def test_messy_rows(messy):
    rows = repeats.remove_repeats(messy, spans=False)
    assert rows.columns == messy.columns
    texts = {}
    for r in rows.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[2] == [None] and texts[3] == [""] and texts[7] == ["", ""] and len(texts[1][0]) > 20
    assert texts[5][0] != "" and texts[6] == [""] and len(texts[None]) == 2
    assert repeats.remove_repeats(messy).count() == 13


def brute(texts, least_chars=40, least_line=24):
    """The texts without repeats, from (doc_id, text) in their order, by a plain walk."""
    seen, want = {}, []
    for row, (_, text) in enumerate(texts):
        own = list(repeats.units(text))
        again = [bool(w) and seen.setdefault(w, (row, k)) != (row, k) for k, (_, _, w, _) in enumerate(own)]
        gone, k = set(), 0
        for line in {u[3] for u in own}:
            members = [k for k, u in enumerate(own) if u[3] == line and u[2]]
            if all(again[k] for k in members) and sum(len(own[k][2]) for k in members) >= least_line:
                gone |= set(members)
        while k < len(own):
            e = k
            while e < len(own) and again[e]:
                e += 1
            if sum(len(own[x][2]) for x in range(k, e)) >= least_chars:
                gone |= set(range(k, e))
            k = max(e, k + 1)
        want.append("".join(text[a:b] for k, (a, b, _, _) in enumerate(own) if k not in gone))
    return want


def test_against_brute_force(spark, documents):
    import random

    rng = random.Random(5)
    sentences = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 12))) + rng.choice(".!?。") for _ in range(40)]
    texts = [(i, "".join(rng.choice(sentences) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(12)))) for i in range(60)]
    found = repeats.remove_repeats(documents(texts)).collect()
    assert {r["doc_id"]: r["text"] for r in found} == dict(zip([i for i, _ in texts], brute(texts), strict=True))


def test_rows_of_one_id_with_different_texts_keep_what_only_they_have(documents):
    only = "Only here a unique first line with more than eight words stands.\nmore"
    rows = [(1, PASSAGE + "\nfirst"), (2, only), (2, PASSAGE + "\nsecond"), (2, only)]
    found = sorted((r["doc_id"], r["text"]) for r in repeats.remove_repeats(documents(rows)).collect())
    assert found == [(1, PASSAGE + "\nfirst"), (2, only), (2, only), (2, "second")]


def test_scripts_without_spaces_and_short_lines(documents):
    chinese = "这是一个没有空格的段落。" * 2 + "它在许多文档里重复出现，所以只应保留最早的一次，其余的都要去掉。" + "还有最后一句话在这里。"
    menu = "Home | Products | About us | Contact"
    rows = [(1, f"{chinese}\n甲"), (2, f"乙\n{chinese}\n丙"), (3, f"{menu}\nOne text.\nYes."), (4, f"{menu}\nAnother text.\nYes.")]
    found = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(documents(rows)).collect()}
    assert found == {1: rows[0][1].replace("这是一个没有空格的段落。" * 2, "这是一个没有空格的段落。" * 2), 2: "乙\n丙", 3: rows[2][1], 4: "Another text.\nYes."}


def test_no_rows(documents):
    assert repeats.remove_repeats(documents([])).count() == 0
