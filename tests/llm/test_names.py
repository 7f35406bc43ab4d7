import itertools

import pytest

from skein.llm import names as N
from skein.sources.tables import table


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Abigail Sanddagvind", "Sanddagvind, Abby", True), ("A. Sanddagvind", "Dr. Abigail Celine Sanddagvind", True), ("Jonas Potbrilkast", "Lars Potbrilkast", False),
        ("Potbrilkast Jonas", "POTBRILKAST, J.", True), ("Michael R. Temhelngig", "Temhelngíg, Mike", True), ("P. Temhelngig", "Michael Temhelngig", False),
        ("Joseph Himbrestdag", "Josephine Himbrestdag", False), ("Perkz-Ifgend, Leila", "Leila Perkzifgend", True), ("Womtempham, T.", "Thomas Womtemfam", True), ("", "Thomas Womtemfam", False),
    ],
)
def test_persons(a, b, same):
    assert N.same_person(N.person(a), N.person(b)) is same


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("The Zapverhub Energy Gp.", "Zapverhub Grp for Energy", True), ("Centre of Energy, Lurmuvjef", "Lurmuvjef Energy Center", True), ("Himflothdok (HGB)", "Himflothdok Genomics Bros.", True),
        ("Himflothdok (XYZ)", "Himflothdok Genomics Bros.", False), ("Kolnhelnwom Acoustics Center", "Kolnhelnwom Acoustics Foundation", False), ("Bupkivvaf Imaging", "Bupkivvaf Imaging Limited", True),
        ("Lithlurfib Energy Institute", "Temjondhav Energy Institute", False),
    ],
)
def test_organisations(a, b, same):
    assert N.same_organisation(N.organisation(a), N.organisation(b)) is same


def test_lcs():
    assert N.lcs("abcde", "ace") == 3 and N.lcs("", "x") == 0 and N.ratio("abcd", "abdc") == 0.75


def brute(rows):
    read = {"PERSON": (N.person, N.same_person), "ORGANIZATION": (N.organisation, N.same_organisation)}
    out = set()
    for kind, (parse, same) in read.items():
        own = [(i, parse(n)) for i, k, n in rows if k == kind and n and n.strip()]
        out |= {(min(i, j), max(i, j)) for (i, x), (j, y) in itertools.combinations(own, 2) if same(x, y)}
    return out


def test_blocking_finds_what_all_pairs_have(spark, sf):
    rows = [(r.id, r.entity_type, r.canonical_name) for r in table(spark, sf, "entities").collect()]
    want = brute(rows)
    got = [tuple(r) for r in N.p5_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.98 * len(want)


def test_common_keys_are_tiled_and_repeats_kept(spark, monkeypatch):
    rows = [(i, "PERSON", f"{n} Mistralfen") for i, n in enumerate(["Goran", "Greta", "Nils", "Hugo"] * 3)]
    rows += [(100, "PERSON", None), (101, "PERSON", "  "), (102, "LOCATION", "Goran Mistralfen"), (None, "PERSON", "Goran Mistralfen"), (103, "PERSON", "?!")]
    df = spark.createDataFrame(rows, "id long, kind string, name string")
    whole = N.variant_classes(df)
    assert sorted(r.class_id for r in whole[0].collect()) == sorted([0, 1, 2, 3] * 3) and whole[1].count() == 0
    many = spark.createDataFrame([(i, "PERSON", f"{g}{c}{d} Mistralfen") for i, (g, c, d) in enumerate(itertools.product(["Gor", "Gre", "Nil"], "aeiou", "nmrs"))], "id long, kind string, name string")
    want = {tuple(r) for r in N.variant_classes(many)[1].collect()}
    monkeypatch.setattr(N, "TILE", 8)
    assert {tuple(r) for r in N.variant_classes(many)[1].collect()} == want == brute([tuple(r) for r in many.collect()])


def test_empty(spark):
    members, links = N.variant_classes(spark.createDataFrame([], "id long, kind string, name string"))
    assert members.count() == 0 and links.count() == 0


def test_swapped_first_letters_under_a_common_surname(spark):
    names = ["Mila Zorbrook", "Imla Zorbrook"] + [f"{a}{b}{a}{b} Zorbrook" for a in "BCDFGHJKL" for b in "aeiouyrtw"]
    rows = [(i, "PERSON", n) for i, n in enumerate(names)]
    assert len(rows) > N.COMMON
    _, links = N.variant_classes(spark.createDataFrame(rows, "id long, kind string, name string"))
    assert (0, 1) in {tuple(r) for r in links.collect()}


@pytest.mark.parametrize("a,b", [("Mila", "Imla"), ("William", "Iwlliam"), ("Bill", "Iwlliam"), ("R", "Bob"), ("Sam", "Samantha")])
def test_refinements_keep_what_may_be_one_given_name(a, b):
    assert N.same_given(a.lower(), b.lower())
    refinements = [{r for k, _, _, refine, _ in N._keys("PERSON", f"{x} Zorbrook") if k == "P+zorbrook" for r in refine} for x in (a, b)]
    assert refinements[0] & refinements[1]


def test_common_words_of_organisations(spark):
    """A word that very many names share is refined and at last discarded; variants meet under their other words, and no key keeps more than COMMON names."""
    parts = [a + b for a in ("zif", "vus", "pik", "lof", "tun", "gle", "kas", "dro", "mur", "wen") for b in ("bral", "dent", "gosk", "hilm", "jurt", "nask", "pomb", "qued", "silt", "vork")]
    rows = [(i, "ORGANIZATION", f"{x} Acoustics {k}") for i, (x, k) in enumerate(itertools.product(parts, ["Group", "Institute", "Trust"]))]
    rows += [(1000 + i, "ORGANIZATION", f"The Acoustics Inst. of {x[:5]}{x[6:]}") for i, x in enumerate(parts)]
    df = spark.createDataFrame(rows, "id long, kind string, name string")
    _, links = N.variant_classes(df)
    assert {tuple(r) for r in links.collect()} == brute(rows)
    index = df.withColumnRenamed("id", "rep").mapInArrow(N._index, "rep long, key string, longer string, kept boolean, refine array<string>, finer array<string>")
    sizes = [r[0] for r in N._blocks(index).groupBy("key").count().select("count").collect()]
    assert max(sizes) <= N.COMMON


def test_repeated_rows_count_once(spark):
    rows = [(1, "PERSON", "Goran Mistralfen"), (2, "PERSON", "Mistralfen, G."), (3, "PERSON", "Goran Mistralfen")]
    members, links = N.variant_classes(spark.createDataFrame(rows * 2, "id long, kind string, name string"))
    assert sorted(tuple(r) for r in members.collect()) == [(1, 1), (2, 2), (3, 1)] and [tuple(r) for r in links.collect()] == [(1, 2)]
