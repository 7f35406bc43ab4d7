import random

from skein.llm import splitting as S
from skein.sources.tables import table

CHUNKS = "id long, document_id long, content string, page_number int, chunk_index int, section string, piece int"


def brute_level(text, size=800):
    import re

    t = text.replace("\r\n", "\n").strip()
    if len(t) <= size:
        return None
    for name, pattern in (("paragraph", r"\n(?:[^\S\n]*\n)+"), ("line", r"\n"), ("sentence", r"\n|(?<=[.!?])\s+"), ("word", r"\s+")):
        if all(len(p.strip()) <= size for p in re.split(pattern, t)):
            return name
    return "none"


def texts():
    r = random.Random(2)
    words = ["alpha", "be", "gamma-ray", "δέλτα", "x" * 30, "end.", "what?", "漢字"]
    out = [None, "", "   ", "short", "a" * 801, "a" * 800, " " * 900, ("line of text\r\n" * 70), "p one.\n \nq two\n\n" * 60, "é" * 5000, "word " * 400]
    for _ in range(60):
        seps = r.choice([[" "], [" ", "\n"], [" ", "\n", "\n\n"], [" ", "\r\n", "\n \n"], [" ", "\t"]])
        out.append("".join(r.choice(words) + r.choice(seps) for _ in range(r.randint(50, 700))))
    return out


def test_levels_pieces_and_overlap(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i, i % 3, t, i % 4 or None, i % 5, None, 9) for i, t in enumerate(all_texts)], CHUNKS)
    got = {r.id: r.cut_at for r in S.split_levels(df).collect()}
    assert got == {i: brute_level(t) for i, t in enumerate(all_texts) if t and brute_level(t)}
    rows = S.split_chunks(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert set(by) == set(range(len(all_texts)))
    for i, t in enumerate(all_texts):
        own = sorted(by[i], key=lambda r: r.piece)
        assert {r.page_number for r in own} == {i % 4 or None}
        if i not in got:
            assert [r.content for r in own] == [t]
            continue
        whole = S.clean(t)
        level, plan = S.plan(whole)
        assert level == got[i] and all(len(r.content) <= 800 for r in own) and len(own) == len(plan)
        # nothing but white space is lost between pieces, and each repeats the end of the one before
        at = 0
        for (a, b), r in zip(plan, own):
            assert not whole[at:a].strip() and r.content.endswith(whole[a:b])
            lead = r.content[: len(r.content) - (b - a)]
            assert len(lead) <= 150 and whole[a - len(lead) : a] == lead
            if a:  # the whole overlap, from the first word's start in it; of a single long word the end
                starts = [k for k in range(max(0, a - 150), a) if not whole[k].isspace() and (k == 0 or whole[k - 1].isspace())]
                assert len(lead) == (a - starts[0] if starts else len(whole[max(0, a - 150) : a].lstrip()))
            at = b
        assert not whole[at:].strip()
    for d in range(3):
        index = sorted((r.chunk_index, r.id, r.piece) for r in rows if r.document_id == d)
        assert [x[0] for x in index] == list(range(len(index)))
        order = [(df_i % 5, df_i, p) for _, df_i, p in index]
        assert order == sorted(order)


def test_null_and_repeated_ids(spark):
    long = "A sentence of some words. " * 60
    rows = [(1, 5, long, 1, 0, None, 0)] * 2 + [(None, 5, long, 2, 1, None, 0), (None, None, "short", None, None, None, 0), (2, 5, None, 3, None, None, 0)]
    got = S.split_chunks(spark.createDataFrame(rows, CHUNKS)).collect()
    n = len(S.plan(S.clean(long))[1])
    assert len(got) == 3 * n + 2 and sorted(r.chunk_index for r in got if r.document_id == 5) == list(range(3 * n + 1))
    assert [r.content for r in got if r.id == 2] == [None] and [r.content for r in got if r.document_id is None] == ["short"]
    one = [r.piece for r in sorted((r for r in got if r.id == 1), key=lambda r: r.chunk_index)]
    assert one == [*range(n), *range(n)]


def test_overlap_as_large_as_the_size():
    import pytest

    with pytest.raises(ValueError):
        S.plan("a b c", 10, 10)


def test_empty_table(spark):
    df = spark.createDataFrame([], CHUNKS)
    assert S.split_levels(df).count() == 0 and S.split_chunks(df).count() == 0


def test_even_pieces():
    level, plan = S.plan("\n\n".join(["x" * 150] * 12))
    sizes = [b - a for a, b in plan]
    assert level == "paragraph" and max(sizes) - min(sizes) <= 152


def test_whole_table(spark, sf):
    rows = {r.id: brute_level(r.content) for r in table(spark, sf, "chunks").select("id", "content").collect() if r.content}
    assert {r.id: r.cut_at for r in S.p1_found(spark, sf).collect()} == {k: v for k, v in rows.items() if v}
