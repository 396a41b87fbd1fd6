"""Italian stems by the Snowball rules, as one Spark expression for a word.

Regions: ``RV``, ``R1`` and ``R2`` are what stands behind certain vowels and consonants of a word. A step takes
the longest of its endings that the word has, and acts if the ending lies in its region.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the letters and endings of the published rules
VOWELS = "aeiouàèìòù"
PRONOUNS = """ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli
    telo tene cela cele celi celo cene vela vele veli velo vene""".split()
PLAIN = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
BEHIND_IC = "azione azioni atore atori".split()
LOGIC = "logia logie".split()
USION = "uzione uzioni usione usioni".split()
ENCE = "enza enze".split()
MENT = "amento amenti imento imenti".split()
AMENTE = ["amente"]
ITY = ["ità"]
IVE = "ivo ivi iva ive".split()
VERBS = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai
    eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo iamo immo irà irai
    iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo
    ivano ivate ivi ivo ono uta ute uti uto ar ir""".split()


def _ending(word: Column, endings: Sequence[str]) -> Column:
    """The longest of ``endings`` that the word has, empty if none."""
    return F.regexp_extract(word, f"({'|'.join(sorted(endings, key=len, reverse=True))})$", 1)


def _cut(word: Column, n: Column, put: str = "") -> Column:
    """The word without its last ``n`` letters, and ``put`` behind it."""
    short = F.substring(word, F.lit(1), F.length(word) - n)
    return F.concat(short, F.lit(put)) if put else short


def _inside(ending: Column, region: Column) -> Column:
    """Whether a word's ending lies in its region, which reaches to the end of the word."""
    return (ending != "") & F.endswith(region, ending)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _regions(word: Column) -> Column:
    v = VOWELS
    behind = f"[{v}][^{v}](.*)$"
    rv = (
        F.when(F.regexp_like(word, F.lit(f"^.[^{v}]")), F.regexp_extract(word, f"^..[^{v}]*[{v}](.*)$", 1))
        .when(F.regexp_like(word, F.lit(f"^[{v}][{v}]")), F.regexp_extract(word, f"^..[{v}]*[^{v}](.*)$", 1))
        .otherwise(F.substring(word, 4, 1 << 20))
    )
    r1 = F.regexp_extract(word, f"^[^{v}]*[{v}]+[^{v}](.*)$", 1)
    r2 = F.regexp_extract(word, f"^[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}](.*)$", 1)
    return F.struct(word.alias("w"), rv.alias("rv"), r1.alias("r1"), r2.alias("r2"))


def _rest(region: Column, removed: Column) -> Column:
    """A region without the last letters of the word, as many as were removed."""
    return F.substring(region, F.lit(1), F.greatest(F.length(region) - removed, F.lit(0)))


def _standard(s: Column) -> Column:
    """The word after the standard endings: null if none was removed."""
    w, rv, r2 = s["w"], s["rv"], s["r2"]
    groups = [PLAIN, BEHIND_IC, LOGIC, USION, ENCE, MENT, AMENTE, ITY, IVE]

    def act(e: Column) -> Column:
        n = F.length(e)
        stem, inner = _cut(w, n), _rest(r2, n)
        also = lambda *endings: _let(_ending(inner, endings), lambda x: _cut(stem, F.length(x)))
        twice = lambda first, second: F.when(F.endswith(inner, F.lit(first)), _let(_cut(stem, F.lit(len(first))), lambda t: F.when(F.endswith(_rest(inner, F.lit(len(first))), F.lit(second)), _cut(t, F.lit(len(second)))).otherwise(t)))
        in_r1 = F.endswith(s["r1"], e)
        return (
            F.when(e == "", None)
            .when(e.isin(*AMENTE), F.when(in_r1, F.coalesce(twice("iv", "at"), F.when(F.regexp_like(inner, F.lit("(os|ic|abil)$")), also("os", "ic", "abil")), stem)))
            .when(e.isin(*MENT), F.when(_inside(e, rv), stem))
            .when(~_inside(e, r2), None)
            .when(e.isin(*BEHIND_IC), also("ic"))
            .when(e.isin(*LOGIC), F.concat(stem, F.lit("log")))
            .when(e.isin(*USION), F.concat(stem, F.lit("u")))
            .when(e.isin(*ENCE), F.concat(stem, F.lit("ente")))
            .when(e.isin(*ITY), also("abil", "ic", "iv"))
            .when(e.isin(*IVE), F.coalesce(twice("at", "ic"), stem))
            .otherwise(stem)
        )

    return _let(_ending(w, [x for g in groups for x in g]), act)


def _pronoun(s: Column) -> Column:
    """The word without a pronoun behind a gerund or an infinitive."""
    w, rv = s["w"], s["rv"]

    def act(e: Column) -> Column:
        before = _rest(rv, F.length(e))
        gerund, infinitive = F.regexp_like(before, F.lit("(ando|endo)$")), F.regexp_like(before, F.lit("(ar|er|ir)$"))
        return F.when(_inside(e, rv) & gerund, _cut(w, F.length(e))).when(_inside(e, rv) & infinitive, _cut(w, F.length(e), "e")).otherwise(w)

    return _let(_ending(w, PRONOUNS), act)


def _verb(s: Column) -> Column:
    """The word without the longest verb ending that lies in ``RV``."""
    return _let(_ending(s["rv"], VERBS), lambda e: _cut(s["w"], F.length(e)))


def _vowel(s: Column) -> Column:
    """The word without a last vowel, an ``i`` before it, and the ``h`` of a last ``ch`` or ``gh``."""
    found = F.regexp_extract(s["rv"], "(i?[aeioàèìò])$", 1)
    short = _cut(s["w"], F.length(found))
    hard = F.regexp_like(_rest(s["rv"], F.length(found)), F.lit("[cg]h$"))
    return F.when(hard, _cut(short, F.lit(1))).otherwise(short)


def italian_stem(word: Column) -> Column:
    """The stem of a lower-case word; null stays null."""
    v = VOWELS
    graved = F.translate(word, "áéíóú", "àèìòù")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(graved, "qu", "qU"), f"(?<=[{v}])u(?=[{v}])", "U"), f"(?<=[{v}])i(?=[{v}])", "I")
    with_regions = lambda w, step: _let(_regions(w), step)
    bare = with_regions(marked, _pronoun)

    def suffixes(w: Column) -> Column:
        return _let(with_regions(w, _standard), lambda done: F.coalesce(done, with_regions(w, _verb)))

    stem = _let(_let(bare, suffixes), lambda w: with_regions(w, _vowel))
    return F.translate(stem, "UI", "ui")


def italian_stems(tokens: Column) -> Column:
    """A ``stem`` for ``clean_tokens``: the stems of an array of words."""
    return F.transform(tokens, italian_stem)
