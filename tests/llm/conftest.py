import pytest

from headway.llm.queries import prepare

CLASHING = (
    "fp string, component_id string, removed string, kept string, length string, part string, score string, n string, "
    "row string, gone_id string, gone_numbers string, _gone string, _id string, shard string, slot string, words string"
)


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang), with columns whose names operators use."""
    def build(rows, lang=None):
        prepare(spark)
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, "src", 1, *["x"] * 16) for r in rows]
        return spark.createDataFrame(
            full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
        )

    return build


@pytest.fixture
def messy(documents):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return documents([
        (1, "The quick brown fox jumps over the lazy dog. It barks."), (2, None), (3, ""), (4, "  \n\t "),
        (5, long), (6, long), (None, "The quick brown fox jumps over the lazy dog. It barks."),
        (7, "The quick brown fox jumps over the lazy dog. It barks."), (7, "The quick brown fox jumps over the lazy dog. It barks."),
        (None, None), (8, "One."), (9, "<|endoftext|> a\tb  c\n\nd"), (10, "日本語 текст ελληνικά"),
    ])
