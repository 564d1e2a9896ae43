import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from atlaskb.config import Settings
from atlaskb.operators.chunking import chunk, split_text
from atlaskb.plans import store_queries


def test_separators_stay_at_the_head_of_the_next_piece():
    assert split_text("aaaa. bbbb. cccc", size=11, overlap=0) == ["aaaa. bbbb", ". cccc"]


def test_windows_overlap_by_whole_pieces():
    assert split_text("aa bb cc dd", size=6, overlap=3, separators=(" ", "")) == ["aa bb", "bb cc", "cc dd"]


def test_long_piece_goes_to_the_next_separator():
    assert split_text("a, bbbbbb, c. d", size=8, overlap=0) == ["a", ", bbbbbb", ", c", ". d"]
    assert split_text("x" * 10, size=4, overlap=1) == ["xxxx", "xxxx", "xxxx"]


@given(st.text(alphabet="ab ,.", max_size=300), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_pieces_keep_the_limit_and_lose_nothing(text, size):
    pieces = split_text(text, size, size // 4)
    assert all(0 < len(p) <= size for p in pieces)
    assert all(p in text for p in pieces)
    joined = "".join(split_text(text, size, 0))
    assert joined.replace(" ", "") == text.replace(" ", "")


def test_chunk_counts_before_short_pieces_go(spark):
    long = "word " * 40
    docs = spark.createDataFrame([(f"{long}\n\nshort\n\n{long}stampa", "u", "T", "html", 5), (None, "v", "T", "html", 6), ("x" * 3000, "w", "", "html", 7)], "text string, source string, title string, doc_type string, extra int")
    rows = {(r.source, r.chunk_index): r for r in chunk(docs, Settings()).collect()}
    assert {k for k in rows if k[0] == "u"} == {("u", 0), ("u", 2)}
    assert rows["u", 0].chunk_total == 3 and rows["u", 0].text.startswith("T\n\nword") and rows["u", 0].extra == 5
    assert not [k for k in rows if k[0] == "v"]
    assert len([k for k in rows if k[0] == "w"]) == 3 and rows["w", 0].text == "x" * 1200


def plain_split(text, separators=(". ", ", ", " ", "")):
    """Recursive splits with the separator kept at the head, merged up to 1,200 characters with overlaps of up to 150."""
    at = next(i for i, s in enumerate(separators) if s in text)
    parts = [p for p in (re.split(f"(?={re.escape(separators[at])})", text) if separators[at] else list(text)) if p]
    out, held = [], []

    def merge():
        window = []
        for p in held:
            if sum(map(len, window)) + len(p) > 1200 and window:
                out.append("".join(window).strip())
                while sum(map(len, window)) > 150 or window and sum(map(len, window)) + len(p) > 1200:
                    window.pop(0)
            window.append(p)
        out.append("".join(window).strip())
        held.clear()

    for p in parts:
        if len(p) < 1200:
            held.append(p)
        else:
            merge()
            out.extend(plain_split(p, separators[at + 1 :]))
    merge()
    return [p for p in out if p]


def plain_chunks(text):
    paragraphs = [p.strip() for p in re.split(r"\n{2,}", text.strip())]
    pieces = [x for p in paragraphs if p for x in ([p] if len(p) <= 1200 else plain_split(p))]
    bodies = ["\n".join(x for line in p.split("\n") if len(x := line.strip()) >= 4) for p in pieces]
    return [(i, len(pieces), f"{text[:30]}\n\n{b}") for i, b in enumerate(bodies) if len(b) >= 80]


def test_queries_chunk_documents_of_any_length(spark, tmp_path):
    words = lambda n, end=" ": end.join(f"word{i}" for i in range(n))
    texts = [
        words(30), words(1500), words(900, ", "), words(900, ". "), "x" * 3000, f"{words(40)}\n\nshort\n\n{words(700)}. {'y' * 1500}, {words(300)}",
        words(400, "\n"), "z" * 1200, f"{'a' * 1199}. {'b' * 1201}", "tiny",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(f"doc/{d}", i): (n, len(t), hashlib.md5(f"doc/{d}::{i}::{t[:64]}".encode()).hexdigest()) for d, text in enumerate(texts) for i, n, t in plain_chunks(text)}
    assert len({source for source, _ in want}) == 9 and max(i for _, i in want) > 5
    assert {(r.source, r.chunk_index): (r.chunk_total, r.n_chars, r.chunk_id) for r in store_queries.chunk_all(spark, str(tmp_path)).collect()} == want
    assert sorted(tuple(r) for r in store_queries.chunk_ids(spark, str(tmp_path)).collect()) == sorted((source, c) for (source, _), (_, _, c) in want.items())
