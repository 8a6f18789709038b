"""Sentence boundaries across languages and scripts, in SQL expressions only.

A message is cut into blocks at blank lines and blocks into list items.  In the
remaining paragraphs full stops that end nothing (decimals, urls, initials,
abbreviations, ordinals before months, all but the last mark inside quotations
and brackets) are masked by one private-use character each, so lengths stay; the
masked text is split by terminator rules for each script, and each
unit is restored as the same span of the original text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK, BREAK = "\ue000", "\ue001"
#: Abbreviations that never end a sentence, by language.
ABBREVIATIONS = (
    "Dr Prof Mr Mrs Ms St Gen Lt Col Sgt Capt Rev Hon Figs figs Fig fig Eq eq Sec sec Chap chap vs approx ca Ca cf Cf resp incl viz pp Vol vol Nos "
    "bzw vgl Vgl Abb Nr Bd Hr Fr evtl ggf inkl Tab Kap Str sog Mio "
    "MM Mme Mlle env Env art Art "
    "Sr Sra Srta Dra aprox Aprox pág Pág núm Núm Ud Uds "
    "dott Dott sig Sig prof pag Pag ing avv "
    "dr mr mevr dhr bijv Bijv blz nr afb "
    "напр Напр рис Рис см См стр табл гл проф им ул "
    "डॉ श्री प्रो"
)
#: Abbreviations of two parts, each with a full stop.
TWO_PART = "z B|d h|u a|p ex|p ej|т е|т к|e g|i e|o ä|s o"
#: Abbreviations that only go before a number.
BEFORE_NUMBER = "No no Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec l ll p S art г т с"
#: Abbreviations that may end a sentence: they don't where a word of CONTINUES follows.
OPEN = "etc usw ecc enz Co Inc Ltd Corp Jr Sr Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
CONTINUES = "and or but in now for of to at by on is are were with than then und oder et ou y e ed en и или но"
MONTHS = "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez"
STOPS = ".!?…؟।॥"
WIDE = "。！？｡"
QUOTES = "\"”“’»」』›"
CLOSERS = QUOTES + ")\\]）］】〉》"
PAIRS = ["„“", "“”", "«»", "‹›", "「」", "『』", "()", "（）", "[]", "【】"]
BULLET = r"[*\-•+–·‣]"
NUMBER = r"\d{1,3}[.)]"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_quote(pattern)}, {_quote(by)})"


def _inner(x: str) -> str:
    """All marks but the last of a quotation or bracket masked."""
    marks = STOPS + WIDE
    return _replace(x, rf"(?s)[{marks}](?=.*[^\s{marks}])", MASK)


def _enclosed(x: str, opener: str, closer: str) -> str:
    """Marks between a pair of different signs masked."""
    head = f"substring_index(s, {_quote(closer)}, 1)"
    cut = f"concat({_inner(head)}, substring(s, length({head}) + 1))"
    opened = f"split({x}, {_quote(chr(92) + opener)}, -1)"
    made = f"array_join(transform({opened}, (s, i) -> if(i > 0 AND contains(s, {_quote(closer)}), {cut}, s)), {_quote(opener)})"
    return f"if(contains({x}, {_quote(opener)}), {made}, {x})"


def _straight(x: str) -> str:
    parts = f"split({x}, '\"', -1)"
    made = f"array_join(transform({parts}, (s, i) -> if(i % 2 = 1 AND i < size({parts}) - 1, {_inner('s')}, s)), '\"')"
    return f"if(contains({x}, '\"'), {made}, {x})"


def masked_stops() -> str:
    """One pattern of the full stops that end nothing.  It starts at the stop itself and
    looks back, so a text is scanned for stops only."""
    word = r"(?<![\p{L}\p{N}\p{M}])"
    going = rf"(?=\s+(?:{'|'.join(CONTINUES.split())})(?![\p{{L}}\p{{N}}]))"
    rules = [
        r"(?<=\d[.])(?=\d)",
        rf"(?<={word}(?:{'|'.join(ABBREVIATIONS.split())})[.])",
        rf"(?=\s+\d)(?<={word}(?:{'|'.join(BEFORE_NUMBER.split())})[.])",
        rf"(?=\s+(?:{'|'.join(MONTHS.split())}))(?<={word}\d{{1,2}}[.])",
        r"(?=\s+\p{Lu})(?<=(?<![\p{L}\p{N}\p{M}.])\p{Lu}[.])",
        rf"(?<={word}(?:dott[.]ssa|sig[.]ra|d[.]w[.]z)[.])",
        rf"{going}(?<={word}(?:{'|'.join(OPEN.split())})[.])",
        rf"{going}(?<=[.\p{{L}}][.]\p{{L}}[.]|[.][.][.])",
    ]
    return "[.](?:" + "|".join(rules) + ")"


def _two_part(x: str) -> str:
    """Both stops of the abbreviations of two parts masked, whatever blanks are between."""
    pairs = [p.split() for p in TWO_PART.split("|")]
    known = "|".join(rf"{a}[.]\s*+{b}[.]" for a, b in pairs)
    first = rf"(?<![\p{{L}}\p{{N}}\p{{M}}])(?={known})(\p{{L}}++)[.](\s*+)(\p{{L}}++)[.]"
    x = _replace(x, first, f"$1{MASK}$2$3{MASK}")
    return _replace(x, r"(?<![\p{L}\p{N}\p{M}])(ad\s++es)[.]", f"$1{MASK}")


def _urls(x: str) -> str:
    """Stops inside urls masked, and one behind a url where the sentence goes on."""
    going = rf"(?=\s+(?:{'|'.join(CONTINUES.split())})(?![\p{{L}}\p{{N}}]))"
    head = r"regexp_extract(s, '^\\S*', 0)"
    inner = _replace(head, r"(?<!^)[.](?=\S)", MASK)
    tail = _replace(f"concat({inner}, substring(s, length({head}) + 1))", rf"^(\S+)[.]{going}", f"$1{MASK}")
    made = f"array_join(transform(split({x}, '://', -1), (s, i) -> if(i > 0, {tail}, s)), '://')"
    return f"if(contains({x}, '://'), {made}, {x})"


def masking_steps() -> list:
    """SQL-to-SQL steps that mask the marks which end nothing; each keeps the length."""
    return [_two_part, _urls, lambda x: _replace(x, masked_stops(), MASK), _straight, *[lambda x, p=p: _enclosed(x, p[0], p[1]) for p in PAIRS]]


def boundary_rule() -> tuple[str, str]:
    """Pattern and replacement that put a BREAK behind each unit of a masked paragraph."""
    # a statement's mark inside a closing quotation, then text of a script without cases: the sentence goes on
    goes_on = rf"(?<![.。｡][{QUOTES}]{{1,2}})"
    spaced = rf"([{STOPS}{WIDE}]++(?:[{CLOSERS}]*+|\s[»›]))(?=\s+[^\s»›])(?:(?<![{QUOTES}])|(?!\s+\p{{Ll}}))(?:{goes_on}|(?!\s+\p{{Lo}}))"
    wide = rf"([{WIDE}]++[{CLOSERS}]*+)(?=[^\sとっ、，]){goes_on}"
    danda = rf"([।॥]++[{CLOSERS}]*+)(?=\S)"
    thai = r"([ก-ฺเ-๎])(?= +[ก-ฺเ-๎])"
    return f"{spaced}|{wide}|{danda}|{thai}", f"$1$2$3$4{BREAK}"


def _placed(pieces: str, base: str) -> str:
    """Pieces of a text with their offsets: array<struct<at, t>>."""
    return (
        f"aggregate({pieces}, named_struct('at', {base}, 'out', cast(array() AS array<struct<at:int,t:string>>)), "
        "(acc, p) -> named_struct('at', acc.at + length(p), 'out', array_append(acc.out, named_struct('at', acc.at, 't', p))), acc -> acc.out)"
    )


def sentence_units(docs: DataFrame, id_col: str, text: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(id, start_off, end_off) of each sentence unit of ``text`` between the offsets in
    columns ``start`` and ``end`` (the whole text by default; offsets outside it are
    moved to its ends), in code points of the text, ends exclusive.

    The first line is a unit whatever it holds, each list item is one without its
    marker, blank lines end units, line breaks alone don't.  A null id is kept; null,
    empty and blank texts have no units; repeated rows give repeated units."""
    n = F.length(F.col(text))
    s = F.least(F.greatest(F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0), F.lit(0)), n)
    e = F.least(F.coalesce(F.col(end), n) if end else n, n)
    df = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), s.cast("int").alias("s"), F.col(text).alias("t"), e.cast("int").alias("e"))
    df = df.select("id", "s", F.expr("substring(t, s + 1, greatest(e - s, 0))").alias("m"))
    # the first line that isn't blank
    df = df.select("id", "s", "m", F.expr(r"regexp_extract(m, '^[\\s]*[^\\n\\r]*', 0)").alias("first"))
    rest = F.expr("substring(m, length(first) + 1)")
    head = F.expr("named_struct('at', s, 't', first, 'kind', 0)")
    blocks = _placed(r"split(rest, '(?<=\\n)(?=[ \\t\\r]*\\n)', -1)", "s + length(first)")
    df = df.select("id", "s", "first", head.alias("head"), rest.alias("rest"))
    df = df.select("id", "head", F.expr(blocks).alias("blocks"))
    marker = rf"^\s*(?:{BULLET}|{NUMBER})[ \t]+"
    any_item = rf"(?<=\n)(?=[ \t]*(?:{BULLET}|{NUMBER})[ \t])"
    bullets = rf"(?<=\n)(?=[ \t]*{BULLET}[ \t])"
    listed = f"b.t RLIKE {_quote(marker)}"
    cut = f"if({listed}, split(b.t, {_quote(any_item)}, -1), split(b.t, {_quote(bullets)}, -1))"
    is_item = f"if({listed}, q.t RLIKE {_quote(marker)}, q.t RLIKE {_quote(rf'^\s*{BULLET}[ \t]+')})"
    items = (
        f"flatten(transform(filter(blocks, b -> b.t RLIKE '\\\\S'), b -> transform({_placed(cut, 'b.at')}, "
        f"q -> named_struct('at', q.at, 't', q.t, 'kind', if({is_item}, 1, 2)))))"
    )
    df = df.select("id", F.expr(f"inline(concat(array(head), {items}))")).where(F.expr(r"t RLIKE '\\S'"))
    # masks, each a column of its own so that no step is computed twice
    # the two signs may stand in the text itself; there they count as a third one
    df = df.withColumn("masked", F.translate("t", MASK + BREAK, "\ue002\ue002"))
    for step in masking_steps():
        df = df.withColumn("masked", F.when(F.col("kind") == 2, F.expr(step("masked"))))
    split = _placed(f"split({_replace('masked', *boundary_rule())}, '{BREAK}', -1)", "at")
    whole = f"array(named_struct('at', at + length(lead), 't', substring(t, length(lead) + 1)))"
    lead = F.when(F.col("kind") == 1, F.regexp_extract("t", marker, 0)).otherwise("")
    df = df.withColumn("lead", lead)
    df = df.select("id", F.expr(f"inline(if(kind = 2, {split}, {whole}))")).where(F.expr(r"t RLIKE '\\S'"))
    blank = r"[\s\p{Z}]"
    begin = F.col("at") + F.length(F.regexp_extract("t", rf"^{blank}*", 0))
    stop = F.col("at") + F.length(F.regexp_replace("t", rf"{blank}+$", ""))
    return df.select("id", begin.cast("long").alias("start_off"), stop.cast("long").alias("end_off"))
