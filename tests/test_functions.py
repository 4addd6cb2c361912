"""Values of single texts: readable forms, IPA, X-SAMPA, syllables, keys, and what can't be read."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from phonoscope.functions import glyphs, notation, plain, simplify, syllable_patterns
from phonoscope.functions.ipa_letters import LETTERS
from phonoscope.functions.ipa_reader import ipa_to_notation, read_ipa
from phonoscope.functions.prosody import marks, syllabify, syllable_count, syllables, written
from phonoscope.functions.rhyme_table import WEIGHTS
from phonoscope.functions.sql import register, with_functions
from phonoscope.functions.xsampa_table import PAIRS
from phonoscope.plans.ranked import ranked_views

READABLE = {
    "txando^": "txandȯ", "surdjyo^": "suṙdjyȯ", "HEth~Ah": "ḥẹtɦạh", "siqk": "siṅk", "txya@+a-a++u": "txyá̖àa̋u", "hwpo$kUi^mUno$s": "hwpo̤kụïmụno̤s",
    "batO_'aH": "batọ̄'aḥ", "s'oQya&te": "s'oq̇ya̰te", "t!arEba": "t̗aṙẹba", "mh!im": "mħim", "p*at.": "p̂aṯ", "nulQ~tQ~": "nul̰t̰",
    "b?ad?": "b̖ad̖", "p*od*h~U&u$t*ak*el*": "p̂od̬ɦụ̰rt̬ak̬el̬", "na/\\q": "nâṅ", "na\\\\q": "ną̏ṅ", "a@+": "á̖", "a+@": "á@", "": "", "?;": "?;",
}
IPA = {
    "ayu$ve^ydU": "ajɹvˈejdə", "'lKadami": "ʔlqadami", "A&_^mplIfaydzoltxahasntayCwa": "æ̰ˈːmplɪfajdzoltʃahasntajðwa", "kahru_dQ~aw'iyy": "kahruːdˤawʔijj",
    "maHh~alliyy": "maχʰallijj", "kIt~a_^b": "kɪt̪aˈːb", "u$U^nIq": "ɹˈənɪŋ", "^a": "a", "a_^": "aˈː", "a+^": "aˈ˦", "a---": "a˩", "mh!": "m̥", "h!": "", "": "",
    "a b": None, "E$": None, "s?": None, "a=": None, "hh!!": "h̥ʼ", "h^!": "ˈhʼ", "a&+": "a̰˦", "---": "˩˨", "n//a\\/": "n˩˥a˥˩˥",
}
READ = {
    "diəm˧˩˨": "diU--U-m", "ka̠ɡa̠sʰʌ̹ŋd͡ʑa̠": "ka_u&ga_u&sh~Uqdjy~a_u&", "səfɪ": "sUfI", "ɔ̂ːi̯.on": "o$_i@on", "kuɾl": "kurl", "ʔɗəwk͡p̚˧˨ʔ": "'d?UU-wkp.'",
    "t͡ɕʌ̹t̚k͈a̠ɾa̠k̚t͡ɕ͈iɭ": "txy~Ut@.ka_u&ra_u&k.t@xy~iL", "n̠a": "nu&a", "f̬a": "fa", "b̥a": "pa", "œø": "e$a$", "ɗ ʰ": "dh~? ", "tʰː": "th~th~", "àa": "a-a", "": "",
}
SYLLABLES = {
    "ayu$ve^ydU": "a - yu$ - ve^y - dU", "fOla^sOfirmja": "fO - la^ - sO - firm - ja", "'lttazalludju": "'lt - ta - zal - lu - dju", "galf'u'l": "galf - 'u'l",
    "gaiaoilfst": "gai - ao - ilfst", "prvst": "prvst", "ladjdja": "ladj - dja", "masQ~sQ~a_sQ~": "masQ~ - sQ~a_sQ~", "KusQ~rumill": "KusQ~ - ru - mill",
    "'lssamaka_tu 'lbuhh~ayri_a_tu": "'ls - sa - ma - ka_ - tu 'l - bu - hh~ay - ri_ - a_ - tu", "bou$U^nIq": "bou$ - U^ - nIq", "ske^ytbou$dIq": "ske^yt - bou$ - dIq",
    "a//^": "a//^", "h~a": "a", "nh!a": "na", "a@^": "a^@", "=.a": ". - a", "": "",
}


def values(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", expression(F.col("t")).alias("v"))
    return [r.v for r in df.orderBy("k").collect()]


def test_readable(spark):
    split = lambda texts: [unicodedata.normalize("NFD", t) for t in texts]
    assert split(values(spark, list(READABLE), notation.readable)) == split(READABLE.values())
    assert values(spark, ["I^", "u$", "U$", "a&!^"], notation.readable) == ["\u00ef", "r", "u\u0323\u0324", "a\u0307\u0331\u0330"]


def test_tokens_spell_the_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeIU$&@-+/\\_!^htdQ~ .=?x1é\n") for _ in range(rng.randrange(12))) for _ in range(300)]
    assert values(spark, texts, lambda t: F.array_join(notation.tokens(t), "")) == texts


def test_machine(spark):
    assert values(spark, ["txando^", "n~", "é"], notation.machine) == ["".join(map(chr, (0xCF36, 0xCF63, 0xBC7F, 0xCF14, 0xCF24, 0xBD87))), chr(0xCF83), "é"]
    assert values(spark, ["a", "aé"], lambda t: notation.machine(t, notation.NULL)) == [chr(0xBC7F), None]
    with pytest.raises(Exception, match="no glyph begins with"):
        values(spark, ["é"], lambda t: notation.machine(t, notation.ERROR))


def test_glyph_codes_are_distinct(spark):
    from phonoscope.sources.tables import glyph_table

    table = glyph_table(spark)
    assert table.count() == table.select("key").distinct().count() == table.select("machine").distinct().count() == 5396


def test_ipa(spark):
    assert values(spark, list(IPA), notation.notation_to_ipa) == list(IPA.values())
    with pytest.raises(Exception, match="Error with part: 1"):
        values(spark, ["a1"], lambda t: notation.notation_to_ipa(t, notation.ERROR))


def test_xsampa(spark):
    pairs = {"b_<": "b̈", "t_h": "t\u0308h", '"f_0A:D@': "ˈf̈0ɑːðə", "r\\`": "r\\˞", "=\\": "ǂ", "ku4l": "kuɾl", "1": "ɨ", "a-b": "ab", "": ""}
    assert values(spark, list(pairs), notation.xsampa_to_ipa) == list(pairs.values())
    assert values(spark, ["b_<", "r\\`", "t_h"], lambda t: notation.xsampa_to_ipa(t, longest_match=True)) == ["ɓ", "ɻ", "tʰ"]
    back = {"diəm˧˩˨": "di@m˧˩˨", "k͈o̞ms͈o": "ko_omso", "ɸʷo̞": "p\\_wo_o", "gɡ": "gg"}
    assert values(spark, list(back), notation.ipa_to_xsampa) == list(back.values())
    assert values(spark, ["siqk"], notation.notation_to_xsampa) == ["siNk"]
    assert len(notation.live_keys()) == 82


def test_read_ipa(spark):
    assert values(spark, list(READ), ipa_to_notation) == list(READ.values())
    assert values(spark, ["7", None, "àa"], lambda t: ipa_to_notation(t, tones=False)) == [None, None, "aa"]
    for bad in ("7", "˥", "k̠", "̥"):
        with pytest.raises(ValueError):
            read_ipa(bad)


def test_syllables(spark):
    assert [" - ".join(s) for s in values(spark, list(SYLLABLES), syllables)] == list(SYLLABLES.values())
    assert values(spark, ["kUba^llU", "a1", None], syllable_count) == [3, None, None]
    for bad, message in {"a//": "Invalid characters found: /", "K!a": "Invalid characters found: !a", "a+@": "Invalid characters found: @", "Wa": "No match found for Wa"}.items():
        with pytest.raises(ValueError, match="^" + message.replace("+", r"\+")):
            syllabify(bad)


def test_syllables_lose_nothing():
    from phonoscope.functions.prosody import read_marks

    rng = random.Random(6)
    for _ in range(2000):
        word = "".join(rng.choice("aeiouIEtdkpbszmnlrfvxjcqwyhg'") for _ in range(rng.randrange(1, 14)))
        assert "".join(syllabify(word)) == "".join(map(str, read_marks(word)))


def test_tables():
    assert (len(glyphs.READABLE), len(PAIRS), len(WEIGHTS), len(LETTERS)) == (116, 181, 140, 225)
    counts = {kind or k: len(syllable_patterns.patterns(listed, kind)) for k, (listed, kind) in enumerate([(syllable_patterns.OPENING, "OPENING"), (syllable_patterns.CLOSING, "CLOSING"), (syllable_patterns.WHOLE, ""), (syllable_patterns.VOWELS, "")])}
    assert counts == {"OPENING": 276, "CLOSING": 1128, 2: 48, 3: 75}


VIEWS = {
    "by~oph~am": [("by~oph~am", 1.0, 864), ("by~opam", 0.6196, 576), ("by~aph~am", 0.572, 540), ("pyopham", 0.4293, 432), ("by~apam", 0.3342, 360), ("pyapham", 0.2153, 270), ("by~ph~m", 0.144, 216), ("by~pm", 0.0489, 144), ("pyphm", 0.0013, 108)],
    "na/\\q": [("na/\\q", 1.0, 864), ("n/\\q", 0.0015, 216)],
    "purchase": [("purchase", 1.0, 864), ("parchasa", 0.5008, 540), ("prchs", 0.0015, 216)],
    "a=.b": [("ab", 1.0, 864), ("ap", 0.501, 432), ("b", 0.2515, 216), ("p", 0.002, 0)],
}


def test_ranked_views(spark):
    words = [w for w in VIEWS if w != "a=.b"]
    df = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    flat = {}
    for r in ranked_views(df, ["word"], "word").orderBy("word", "place").collect():
        flat.setdefault(r.word, []).append((r.text, r.mass, r.raw_mass))
    assert flat == {w: VIEWS[w] for w in words}
    rows = df.select("word", simplify.simplify(F.col("word")).alias("v")).collect()
    assert {r.word: None if r.v is None else [(x.text, x.mass) for x in r.v] for r in rows} == {**{w: [(t, m) for t, m, _ in VIEWS[w]] for w in words}, "": [], None: None}


def test_view_load_and_range(spark):
    views = values(spark, ["ba+_h~e-"], simplify.simplify)[0]
    assert len(views) == 18 and len({round(v.mass, 4) for v in views}) == 13
    assert views[0].load == {"vowel": "all", "consonant": "all", "tone": "yes", "duration": "yes", "aspiration": "yes"}
    assert views[0].mass == 1 and all(v.mass > 0 for v in views) and len({v.code for v in views}) == 18
    assert [v.text for v in views[2:5]] == ["ba+_e-", "ba+h~e-", "ba_h~e"]


def test_plain_functions_agree_with_expressions(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("aeIuU$&@-+/\\_!^htdQ~G .=?x1éo") for _ in range(rng.randrange(10))) for _ in range(400)] + [*READABLE, *IPA, None]
    for name, (function, _) in plain.SCALARS.items():
        expression = getattr(notation, name)
        assert values(spark, texts, expression) == [None if t is None else function(t) for t in texts], name
    some = [t for t in texts[:60] if t] + ["by~oph~am", "greIdAotxs", "Kad~Q~a_^'"]
    found = values(spark, some, simplify.simplify)
    assert [[(v.text, v.code, v.mass, v.load) for v in views] for views in found] == [plain.simplified(t) for t in some]


def test_marks(spark):
    texts = ["kIt~a_^b", "nh!a&-", "a1", None, "=.a@"]
    found = values(spark, texts, marks)
    assert found[2:4] == [None, None] and [m.value for m in found[0]] == ["k", "I", "t", "a", "b"]
    assert (found[1][0].features, found[1][1].features, found[1][1].tone) == (["voiceless"], ["nasal"], "-")
    assert values(spark, texts, lambda t: written(marks(t))) == ["kIt~a_^b", "na&-", None, None, ".a@"]


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT readable('siqk') AS r, machine('n~') AS m, notation_to_ipa('siqk') AS i, xsampa_to_ipa('=\\\\') AS x, tokens('a+b') AS t, marks('ta')[1].kind AS k").first()
    assert tuple(row) == ("sin\u0307k", chr(0xCF83), "siŋk", "ǂ", ["a+", "b"], "vowel")
    views = spark.sql("SELECT place, text, mass, load['vowel'] AS vowel FROM VALUES ('purchase') AS t(w), LATERAL simplified_rows(w) ORDER BY place").collect()
    assert [tuple(v) for v in views] == [(1, "purchase", 1.0, "all"), (2, "parchasa", 0.5008, "one"), (3, "prchs", 0.0015, "none")]
    assert spark.sql("SELECT syllables('kUba^llU') AS s, ipa_to_notation('kuɾl') AS n").first() == (["kU", "ba^l", "lU"], "kurl")
    rows = spark.sql("SELECT w, pos, syllable FROM VALUES ('ladjdja'), ('a1') AS t(w), LATERAL syllable_rows(w) ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [("ladjdja", 0, "ladj"), ("ladjdja", 1, "dja")]
    df = with_functions(spark.createDataFrame([("siqk",)], "w string"), "w", "readable", "notation_to_ipa", "syllable_count")
    assert df.first() == ("siqk", "sin\u0307k", "siŋk", 1)


def test_nulls_and_long_texts(spark):
    long = "ta " * 20000
    for name in ("readable", "machine", "ipa_to_xsampa", "xsampa_to_ipa"):
        found = values(spark, [None, "", long], getattr(notation, name))
        assert found[:2] == [None, ""] and len(found[2]) == len(long)


def test_lookup(spark):
    from phonoscope.operators.lookup import phonetic_lookup, rhyme_score

    words = spark.createDataFrame([("bat",), ("pat",), (None,), ("bat",)], "word string")
    entries = spark.createDataFrame([("pat",), ("zed",)], "word string")
    found = {(r.word, r.entry): r.score for r in phonetic_lookup(words, entries).collect()}
    assert found["pat", "pat"] == 1 and 0 < found["bat", "pat"] < 1 and ("bat", "zed") not in found
    df = spark.createDataFrame([("mat", "nat"), ("aa", "t"), ("mN", "Nm")], "a string, b string").select(rhyme_score(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == [0.95, 0.0, pytest.approx((0.85 + 0.7) / 2)]


def test_streams(spark, tmp_path):
    from phonoscope.streaming.stream import converted, key_counts

    rows = [("2024-01-01 00:10:00", "bat"), ("2024-01-01 00:20:00", "pat"), ("2024-01-01 03:00:00", "bat")]
    source = spark.createDataFrame(rows, "at string, word string").select(F.col("at").cast("timestamp").alias("at"), "word")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("made", converted(stream, "word", "machine", "code"), "append"), ("keys", key_counts(stream, "word", "at"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {r.code for r in spark.table("made").collect()} == set(values(spark, ["bat", "pat"], notation.machine))
    assert {(r.window.start.hour, r.text): r.n for r in spark.table("keys").collect()}[0, "pat"] == 2
