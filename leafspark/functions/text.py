"""Text rules as column expressions: sound effects, style hints, names of fonts, wrapping, prompts, best texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, tones and style suffixes that decide results.
SFX_WORDS = """
BOOM POW BAM CRASH BANG WHAM ZAP KAPOW WHOOSH THUD CRACK SPLASH RATTLE GRUNT GROAN GASP ROAR HISS BUZZ CLICK SNAP SLAM
THUMP CREAK SQUEAK WHOMP KRAK KRASH SPLOOSH BLAM ZAPP KRAKOOM SKREEEE FWOOSH WOOOSH THWIP
""".split()
COMMON_WORDS = """
THE AND BUT FOR NOT YOU ARE WAS HAS HAD HIS HER ITS OUR OUT WHO ALL ONE CAN MAY YES NO OH AH WELL NOW JUST EVEN ALSO
ONLY VERY MUCH MORE SOME ANY HOW WHY WHAT WHEN THEN THAN THAT THIS WITH FROM INTO UPON HAVE BEEN WILL WOULD COULD SHOULD
MIGHT MUST OF IN ON TO AT BY UP IF AS AN OR SO DO GO HE IT ME MY US WE AM IS BE HI OK SUCH EACH BOTH MANY MOST LESS ELSE
OWN NEW OLD BIG BAD FEW FAR OFF GET GOT LET SAY SEE SET PUT RUN USE TRY ASK BUY CUT EAT HIT WIN INDEED OUTSIDE INSIDE
ABOVE BELOW NEVER EVER REALLY TRULY CLEARLY SIMPLY MERELY QUITE RATHER PERHAPS ALREADY ALWAYS AGAIN AWAY BACK DOWN GOOD
GREAT SMALL LARGE LONG LAST NEXT SAME RIGHT LEFT STILL OVER DONE GONE COME KNOW LOOK TAKE MAKE SEEM NEED WANT KEEP HOLD
FINE SURE TRUE FREE FULL HIGH HALF FOOL WISE DEAD LIVE MIND SOUL HAND EYES FACE TIME LIFE WORD PLACE WORLD POWER ORDER
WAIT STOP HELP PLEASE THANK SORRY EXCUSE LISTEN WATCH HURRY CAREFUL QUICKLY SLOWLY AMAZING TERRIBLE WONDERFUL HORRIBLE
IMPOSSIBLE WHERE WHICH WHILE WHOSE WHOM
""".split()
TONES = ("angry", "sad", "happy", "neutral", "tense", "comedic", "dramatic", "whispering")
STYLES = ("Bold", "Italic", "Light", "Medium", "Regular", "Black", "Thin", "ExtraBold")

#: White space as the rules see it (ASCII and the no-break and Unicode spaces).
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Non-empty stretches between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def effective_text(manual: Column, refined: Column, translated: Column, corrected: Column, raw: Column) -> Column:
    return F.when(F.coalesce(manual, F.lit(False)) & (F.coalesce(translated, F.lit("")) != ""), translated).otherwise(first_filled(refined, translated, corrected, raw))


def effective_ocr_text(corrected: Column, raw: Column) -> Column:
    return first_filled(corrected, raw)


def is_sfx(text: Column) -> Column:
    """A listed word, a *wrapped* or ~wrapped~ one, or a single shouted word that isn't a common one. Null is none."""
    upper = F.upper(strip(F.coalesce(text, F.lit(""))))
    bare = strip(F.regexp_replace(upper, "[!?]+$", ""))
    shouted = upper.rlike(r"^[A-Z]{2,}!+[?]?$") & ~bare.isin(COMMON_WORDS)
    return (upper != "") & (bare.isin(SFX_WORDS) | upper.rlike(r"^[*~][A-Z\s]+[*~]$") | shouted)


def style_hint(text: Column) -> Column:
    """Struct of n_words, n_caps, dominant_caps, n_lines; a word in capitals has two letters or more."""
    ws = words(text)
    caps = F.size(F.filter(ws, lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))))
    return F.struct(
        F.size(ws).cast("long").alias("n_words"), caps.cast("long").alias("n_caps"), (caps * 2 > F.size(ws)).alias("dominant_caps"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
    )


def is_garbage(text: Column) -> Column:
    """More than one character, but no letter."""
    return (F.length(text) > 1) & ~text.rlike(r"\p{L}")


def font_name(stem: Column) -> Column:
    """Struct of family and style from a font's file stem; the first style suffix that fits counts."""
    style = F.coalesce(*[F.when(stem.endswith(s), s) for s in STYLES], F.lit("Regular"))
    known = F.greatest(*[F.when(stem.endswith(s), 1).otherwise(0) for s in STYLES]) == 1
    family = F.regexp_replace(F.replace(F.replace(stem, F.concat(F.lit("-"), style), F.lit("")), style, F.lit("")), "^-+|-+$", "")
    return F.struct(F.when(known, F.when(family == "", stem).otherwise(family)).otherwise(stem).alias("family"), style.alias("style"))


def tone(value: Column) -> Column:
    """A known tone in lower case, else neutral."""
    low = F.lower(value)
    return F.when(low.isin(*TONES), low).otherwise("neutral")


def safe_label(text: Column) -> Column:
    return F.substring(F.translate(text, "/ ", "__"), 1, 30)


def changed(translated: Column, source: Column) -> Column:
    """Whether a translation says anything else than the source, case aside."""
    return (strip(translated) != "") & (F.lower(strip(translated)) != F.lower(strip(source)))


def render_hash(text: Column, preset: Column, tone_: Column, box: Column) -> Column:
    """First 12 digits of the MD5 of text, preset, tone and box, as text, each followed by a bar."""
    return F.left(F.md5(F.concat(text, F.lit("|"), preset, F.lit("|"), tone_, F.lit("|["), F.array_join(F.transform(box, lambda v: v.cast("string")), ", "), F.lit("]|")).cast("binary")), F.lit(12))


def source_hash(content: Column, most: int | None = 65536) -> Column:
    """First 16 digits of the MD5 of the first `most` bytes, of all with None; empty for missing content."""
    return F.coalesce(F.left(F.md5(content if most is None else F.substring(content, 1, most)), F.lit(16)), F.lit(""))


def wrap(text: Column, width: Column | int) -> Column:
    """Lines of a greedy wrap by characters; a longer word stands alone on its line. No words, no lines.

    One pass of an expression: a line is the longest stretch from a word's start to a word's end within the width."""
    width = width if isinstance(width, Column) else F.lit(width)
    line = F.concat(F.lit("(?s)[^ ](?:.{0,"), (width - 2).cast("string"), F.lit("}[^ ])?(?= |\\z)|[^ ]+"))
    return F.regexp_extract_all(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), F.when(width > 2, line).otherwise("[^ ]+"), F.lit(0))


def fix_widow(lines: Column) -> Column:
    """A last line of one word gets the last word of the line before, if that has more than one."""
    n = F.size(lines)
    last, before = F.element_at(lines, -1), F.split(F.get(lines, n - 2), " ")
    moved = F.concat(F.slice(lines, F.lit(1), n - 2), F.array(F.array_join(F.slice(before, F.lit(1), F.size(before) - 1), " "), F.concat_ws(" ", F.element_at(before, -1), last)))
    return F.when((n >= 2) & (F.size(F.split(last, " ")) == 1) & (F.size(before) > 1), moved).otherwise(lines)


def wrap_for_shape(text: Column, width: Column | int, shape: Column) -> Column:
    """Lines for a shape: tall ones are wrapped to 0.82 of the width; widows are mended."""
    width = width if isinstance(width, Column) else F.lit(width)
    narrow = (width * F.lit(0.82).cast("double")).cast("int")
    return fix_widow(F.when(shape == "TALL", wrap(text, narrow)).otherwise(wrap(text, width)))


def prompt(text: Column, tone_: Column, context: Column, scene: Column, kind: Column) -> Column:
    """A request to translate; single words get a shorter one, and the last three context lines come first."""
    lines = F.when(F.size(context) > 0, F.concat(F.lit("Earlier:\n"), F.array_join(F.transform(F.slice(context, F.greatest(F.size(context) - 2, F.lit(1)), F.lit(3)), lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n"))).otherwise("")
    single = F.concat(lines, F.lit("Translate this word ("), tone_, F.lit("): "), text)
    full = F.concat(lines, F.lit("Scene: "), F.when(scene == "", "Panel").otherwise(scene), F.lit("; tone: "), tone_, F.lit("; kind: "), kind, F.lit("\nTranslate: "), text)
    return F.when(F.size(words(text)) == 1, single).otherwise(full)
