"""Variant spellings of names: suffix blocking and longest common subsequences.

Names are indexed by the suffixes of their tokens, and of the tokens read
backwards, so that one typing error leaves a suffix of either kind intact.  A
suffix that many names share is refined with other fields of the name: the
initials of its other parts, then their beginnings and ends.  What is common
even then is discarded, as names that mean the same share rarer suffixes, too;
only of a person's nearly whole surname all pairs are compared, in tiles.
Pairs are accepted by the ratio of the longest common subsequence of their
tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.skew import join_classes
from skein.session import materialize, shuffle_partitions
from skein.sources.tables import table

#: Shortest suffix that is indexed.
MIN_SUFFIX = 3
#: Names under one suffix above which it is refined and at last discarded, and names of one tile.
COMMON, TILE = 64, 128
#: Letters that a suffix may lack of a surname to be nearly the whole of it, which is never discarded.
NEARLY = 3
#: Least ratio of the longest common subsequence of two tokens that mean the same.
RATIO = 0.8

# Forms of address, which are no part of a name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md jr sr ii iii iv rev hon ing mag".split())
# Words that join the parts of an organisation's name.
FILLERS = frozenset("the of for and in on at de der des die das und fur la el los las y e a an".split())
# Kinds of organisation with the ways they are written.
KINDS = {
    "association": "assoc assn asso association", "brothers": "bros bro brothers", "center": "ctr cntr cen cent centre center", "committee": "comm cttee cmte committee",
    "company": "co company comp", "corporation": "corp corpn corporation", "council": "cncl council", "department": "dept dep dpt department", "foundation": "found fdn fndn foundation",
    "group": "grp gp group", "holding": "holdings hldg holding", "incorporated": "inc incorporated", "institute": "inst instit institution institute", "international": "intl int internat international",
    "laboratories": "lab labs laboratory laboratories", "limited": "ltd limited", "office": "off office", "organization": "org organisation organization", "partners": "ptnrs partner partners",
    "school": "sch school", "society": "soc society", "trust": "tr trust", "union": "un union", "university": "univ uni universitat university", "agency": "agcy agency",
    "academy": "acad academy", "college": "coll college", "bureau": "bur bureau", "network": "netw network", "gmbh": "gmbh", "ag": "ag", "llc": "llc", "plc": "plc",
}
_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
# Given names with their short and pet forms.
NICKNAMES = """
abigail abby gail abbie; alexander alex sandy xander lex; alexandra sandra lexi; andrew andy drew; anthony tony ant; barbara barb babs barbie; benjamin ben benny; catherine cathy kate katie cat;
charles charlie chuck chas; christine chris tina chrissy; christopher chris kit topher; cynthia cindy; daniel dan danny; david dave davey; deborah deb debbie; donald don donnie; dorothy dot dottie dolly;
edward ed eddie ted ned; elizabeth liz beth betty eliza lizzie lisa; eugene gene; frances fran; francis frank; frederick fred freddy; gabriel gabe; gerald gerry jerry; gregory greg; henry harry hank;
jacob jake; james jim jimmy jamie; jeffrey jeff; jennifer jen jenny; jessica jess jessie; john jack johnny; jonathan jon; joseph joe joey; josephine jo josie; joshua josh; katherine kathy kate katie kay;
kenneth ken kenny; lawrence larry; leonard len lenny leo; margaret maggie meg peggy marge; martin marty; matthew matt; michael mike mick micky; nathan nate; nathaniel nate; nicholas nick nicky;
pamela pam; patricia pat patty trish; patrick pat paddy; peter pete; philip phil; phillip phil; raymond ray; rebecca becky becca; richard rick dick rich ricky; robert bob rob bobby robbie; ronald ron ronnie;
samantha sam; samuel sam sammy; stephanie steph; stephen steve; steven steve; susan sue susie suzy; theodore ted theo; theresa terry tess; thomas tom tommy; timothy tim timmy; valerie val; veronica ronnie vera;
victoria vicky tori; vincent vince; walter walt wally; william will bill billy willy; zachary zach
"""
_FULL: dict[str, frozenset[str]] = {}
for _group in NICKNAMES.replace("\n", " ").split(";"):
    _names = _group.split()
    for _n in _names:
        _FULL[_n] = _FULL.get(_n, frozenset()) | {_names[0]}

# Further common given names, by which a surname is told from a given name.
GIVEN = """
adam ahmed aisha alan albert alice amara amina amy ana andrea angela anita anna antonio astrid bashir beatrice brian bruno carla carlos carmen celine clara claudia colin dario diana diego dmitri dunja
elena elias emil emily emma erik esther eva fatima farid felix fiona george georg goran grace greta hans hannah hassan heidi helen helena henrik hugo ibrahim igor ingrid irene isabel ivan jan jana javier
jonas jorge juan julia karin karl kenji kimberly klaus lars laura leila linda lucas luca lucia luis magnus maja manuel marco maria marie mario marta mateo mei milan mohammed monica nadia natalia nils nina
nora oliver olga omar oscar otto pablo paul paula pavel pedro penelope petra priya quentin rachel rafael ravi rosa ruth sara sarah sean selma simon sofia sonia sven tanja tariq tobias ursula viktor wanda
yuki yusuf zoltan
"""
_COMMON = frozenset(GIVEN.split()) | frozenset(_FULL)

_TOKEN = re.compile(r"[^\W_]+")


def fold(name: str) -> str:
    """Lower case, without accents, apostrophes or hyphens inside words."""
    s = unicodedata.normalize("NFKD", name.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    return re.sub(r"(?<=[^\W_])['’‐-](?=[^\W_])", "", s)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    v = mask
    for c in b:
        u = v & peq.get(c, 0)
        v = (v + u) | (v - u)
    return (~v & mask).bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    if 2 * short < RATIO * (short + long) - 1:
        return 0.0
    return 2 * lcs(a, b) / (len(a) + len(b))


_SOUND = (("ph", "f"), ("ck", "k"), ("ks", "x"), ("th", "t"), ("w", "v"), ("z", "s"), ("y", "i"), ("j", "i"), ("c", "k"), ("q", "k"))


def sound(t: str) -> str:
    for a, b in _SOUND:
        t = t.replace(a, b)
    return t


def close(a: str, b: str) -> bool:
    """Whether two long tokens are spellings of one: by their common subsequence, as written or by sound."""
    r = ratio(a, b)
    if r >= 0.84 or (r >= 0.6 and ratio(sound(a), sound(b)) >= 0.84):
        return True
    return r >= RATIO and min(len(a), len(b)) >= 8


def same_given(a: str, b: str) -> bool:
    """Whether two given names can be one: equal, an initial, a pet form, or a misspelling."""
    if a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return True
        one, other = (a, b) if len(a) == 1 else (b, a)
        return any(f[0] == one for f in _FULL.get(other, ()))
    fa, fb = _FULL.get(a), _FULL.get(b)
    if fa and fb:
        return bool(fa & fb)
    return _misspelt(a, b) or any(_misspelt(b, f) for f in fa or ()) or any(_misspelt(a, f) for f in fb or ())


def _misspelt(a: str, b: str) -> bool:
    if min(len(a), len(b)) < 4 or not (a[0] == b[0] or a[:2] == b[1::-1]):
        return False
    return lcs(a, b) >= max(len(a), len(b)) - 1 or ratio(a, b) >= 0.88


def person(name: str) -> list[tuple[str, list[str], bool]]:
    """Readings of a person's name: (surname, given names, sure).  The surname stands before a comma, or last, or, less surely, first."""
    s = fold(name)
    parts = [p for p in s.split(",") if _TOKEN.search(p)]
    tokens = [[t for t in _TOKEN.findall(p) if t not in TITLES] for p in parts]
    tokens = [t for t in tokens if t]
    if len(tokens) > 1:
        before, after = tokens[0], [t for p in tokens[1:] for t in p]
        return [(before[-1], [*before[:-1], *after], True)]
    t = tokens[0] if tokens else []
    if len(t) < 2:
        return [(t[0], [], True)] if t else []
    out = [(t[-1], t[:-1], True), (t[0], t[1:], False)]
    # a token that is a known given name or an initial is no surname while the other end can be one
    fit = [r for r in out if len(r[0]) >= 4 and r[0] not in _COMMON]
    return [(x, y, sure or len(fit) == 1) for x, y, sure in fit] or out[:1]


def same_person(a: list, b: list) -> bool:
    for sa, ga, ua in a:
        for sb, gb, ub in b:
            if not ga or not gb or not same_given(ga[0], gb[0]) or not close(sa, sb):
                continue
            if not ua and not ub and min(len(x) for x in ga + gb) == 1:
                continue  # an initial would stand for a surname
            if all(any(same_given(x, y) for y in gb[1:]) for x in ga[1:]) or all(any(same_given(x, y) for y in ga[1:]) for x in gb[1:]):
                return True
    return False


def organisation(name: str) -> dict:
    """Parts of an organisation's name: kinds, an acronym in brackets, and the other words, in the order they stand."""
    s = fold(name)
    acronym = [a for a in re.findall(r"\(([a-z.]{2,8})\)", s)]
    s = re.sub(r"\(([a-z.]{2,8})\)", " ", s)
    kinds, words = [], []
    for t in _TOKEN.findall(s):
        if t in FILLERS:
            continue
        if t in _KIND:
            kinds.append(_KIND[t])
        else:
            words.append(t)
    return {"kinds": sorted(set(kinds)), "acronym": acronym[0].replace(".", "") if acronym else "", "words": words}


def _abbreviates(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return len(short) >= 3 and long.startswith(short)


def same_organisation(a: dict, b: dict) -> bool:
    if a["kinds"] and b["kinds"] and not set(a["kinds"]) & set(b["kinds"]):
        return False
    few, many = sorted((a["words"], b["words"]), key=len)
    if not few:
        return False
    left, strong = list(many), False
    for w in few:
        at = next((x for x in left if x == w), None) or next((x for x in left if min(len(x), len(w)) >= 5 and close(x, w)), None) or next((x for x in left if _abbreviates(x, w)), None)
        if at is None:
            return False
        left.remove(at)
        strong = strong or (min(len(at), len(w)) >= 5 and close(at, w))
    if not strong:
        return False
    for x, y in ((a, b), (b, a)):
        if x["acronym"] and not y["acronym"]:
            initials = sorted([w[0] for w in y["words"]] + [k[0] for k in y["kinds"]])
            if len(initials) == len(x["acronym"]) and initials != sorted(x["acronym"]):
                return False
    if a["acronym"] and b["acronym"] and sorted(a["acronym"]) != sorted(b["acronym"]):
        return False
    # two names of a single word in common: one of them has nothing else to go by
    return len(few) > 1 or len(left) <= 1


def _keys(kind: str, name: str) -> list[tuple[str, str, bool, tuple[str, ...], tuple[str, ...]]]:
    """(suffix key, next letter, kept, refinements, finer ones) of a name.

    One for each suffix of each word that can tell names apart: the letter
    that would lengthen the suffix, whether it is never discarded, and by what
    the name's other words can meet those of its variants.
    """
    rows = []
    if kind == "PERSON":
        heads: dict[str, set[str]] = {}
        for s, gs, _ in person(name):
            # same_given accepts swapped first letters, so the second counts, too
            heads.setdefault(s, set()).update(*({g[0], *(g[1] if len(g) >= 4 else "")} | {f[0] for f in _FULL.get(g, ())} for g in gs[:1]))
        rows = [(s, hs or {""}, {""}) for s, hs in heads.items()]
    else:
        ws = organisation(name)["words"]
        for w in dict.fromkeys(ws):
            if len(w) >= 5:
                others = [x for x in ws if x is not w]
                rows.append((w, {x[0] for x in others} or {""}, {y for x in others for y in (f"{x[:3]}-", f"-{x[-3:]}")} or {""}))
    out = []
    for w, refine, finer in rows:
        for form, v in (("+", w), ("-", w[::-1])):
            for n in range(min(MIN_SUFFIX, len(v)), len(v) + 1):
                out.append((f"{kind[0]}{form}{v[len(v) - n:]}", v[len(v) - n - 1 : len(v) - n], kind == "PERSON" and n >= len(v) - NEARLY, tuple(sorted(refine)), tuple(sorted(finer))))
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "longer", "kept", "refine", "finer"]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
    for b in batches:
        reps, rows = [], []
        for rep, kind, name in zip(*(c.to_pylist() for c in b.columns)):
            own = _keys(kind, name)
            reps += [rep] * len(own)
            rows += own
        cols = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["rep", *names])


def _blocks(index: DataFrame) -> DataFrame:
    """(key, rep, longer, n): names under keys that at least two and, but for kept ones, at most COMMON share; more common keys by their refinements instead."""
    out, left = None, index
    for more in ("refine", "finer", None):
        counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = join_classes(left, counts, ["key"], "n")
        fine = F.col("n") <= COMMON
        own = sized.filter(fine | (F.col("kept") if more is None else F.lit(False))).select("key", "rep", "longer", "n")
        out = own if out is None else out.unionByName(own)
        if more:
            left = sized.filter(~fine).select("rep", "longer", "kept", "refine", "finer", F.explode(F.transform(more, lambda r: F.concat_ws("|", "key", r))).alias("key"))
            left = materialize(left)
    return out


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, kind, name): the folded spelling, with what the rules read of it kept (commas and brackets)."""
    for b in batches:
        ids, kinds, names = [], [], []
        for i, k, n in zip(*(c.to_pylist() for c in b.columns)):
            s = re.sub(r"\s+", " ", re.sub(r"[^\w\s,().]", " ", fold(n))).strip(" ,.")
            if _TOKEN.search(s):
                ids.append(i), kinds.append(k), names.append(s)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "kind": pa.array(kinds, pa.string()), "name": pa.array(names, pa.string())})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each tile; rows come sorted by tile.

    Two names are compared under the longest suffix that they share: where
    the same letter lengthens both, they meet under the longer suffix, too.
    """

    read: dict[tuple[str, str], object] = {}

    def parsed(kind: str, name: str):
        if (kind, name) not in read:
            if len(read) > 200_000:
                read.clear()
            read[kind, name] = person(name) if kind == "PERSON" else organisation(name)
        return read[kind, name]

    def tile(rows: list[tuple]) -> tuple[list[int], list[int]]:
        a_out, b_out = [], []
        rows = [(rep, side, longer, kind, parsed(kind, name)) for rep, side, longer, kind, name in rows]
        for i, (ra, sa, la, ka, pa_) in enumerate(rows):
            same = same_person if ka == "PERSON" else same_organisation
            for rb, sb, lb, kb, pb in rows[i + 1 :]:
                if (la and la == lb) or ra == rb or ka != kb or (sa == sb and sa != 0):
                    continue
                if same(pa_, pb):
                    a_out.append(min(ra, rb)), b_out.append(max(ra, rb))
        return a_out, b_out

    done: set[tuple[int, int]] = set()

    def emit(rows):
        a, b = tile(rows)
        new = [(x, y) for x, y in dict.fromkeys(zip(a, b)) if (x, y) not in done]
        if len(done) > 500_000:
            done.clear()
        done.update(new)
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in new], pa.int64()), "b": pa.array([y for _, y in new], pa.int64())})

    key, rows = None, []
    for b in batches:
        for t, *r in zip(*(c.to_pylist() for c in b.columns)):
            if t != key:
                if len(rows) > 1:
                    yield emit(rows)
                key, rows = t, []
            rows.append(tuple(r))
    if len(rows) > 1:
        yield emit(rows)


def variant_classes(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of (id, kind, name), kind PERSON or ORGANIZATION: members (id, class_id) puts equal folded spellings into one class, links (a, b) joins classes.

    Null, blank and letterless names and null ids take no part, repeated rows
    count once.  Classes are compared, not rows, so a spelling that a third of
    all rows share counts once; they are compared if they share a key that is
    not discarded.
    """
    src = names.filter(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("kind").isin("PERSON", "ORGANIZATION"))
    folded = materialize(src.select(F.col("id").cast("long").alias("id"), "kind", "name").mapInArrow(_fold_batches, "id long, kind string, name string").distinct())
    classes = materialize(folded.groupBy("kind", "name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    members = join_classes(folded, classes, ["kind", "name"]).select("id", F.col("rep").alias("class_id"))
    index = materialize(classes.select("rep", "kind", "name").repartition(shuffle_partitions(names.sparkSession)).mapInArrow(_index, "rep long, key string, longer string, kept boolean, refine array<string>, finer array<string>"))
    placed = materialize(_blocks(index)).withColumn("tiles", F.when(F.col("n") > COMMON, F.ceil(F.col("n") / TILE)).otherwise(1).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # tile (i, j) compares block i with block j: a row of block i goes to every tile that names i
    dealt = placed.select("rep", "key", "longer", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(tile.alias("tile"), "rep", side.alias("side"), "longer").join(classes.select("rep", "kind", "name"), "rep")
    links = dealt.select("tile", "rep", "side", "longer", "kind", "name").repartition("tile").sortWithinPartitions("tile").mapInArrow(_compare, "a long, b long").distinct()
    return members, links


def entity_names(entities: DataFrame) -> DataFrame:
    """(id, kind, name) of persons and organisations; the display name where there is no canonical one."""
    name = F.when(F.length(F.trim(F.coalesce("canonical_name", F.lit("")))) > 0, F.col("canonical_name")).otherwise(F.col("display_name"))
    return entities.select("id", F.upper(F.trim("entity_type")).alias("kind"), name.alias("name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): rows of entities that mean the same person or organisation."""
    members, links = variant_classes(entity_names(table(spark, d, "entities")))
    members, links = materialize(members), materialize(links)
    m = lambda side: members.select(F.col("class_id").alias(side), F.col("id").alias(f"id_{side}"))
    across = links.join(m("a"), "a").join(m("b"), "b").select("id_a", "id_b")
    inside = m("a").withColumnRenamed("a", "c").join(m("b").withColumnRenamed("b", "c"), "c").filter("id_a < id_b").select("id_a", "id_b")
    return across.unionAll(inside).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, class_id, n_links): one row per person and organisation with its spelling's class and how many other classes it is linked to."""
    members, links = variant_classes(entity_names(table(spark, d, "entities")))
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "class_id", "left").select(F.col("id").alias("entity_id"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
