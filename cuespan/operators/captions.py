"""Captions from a locked script: its letters on recognised times, clauses cut at real pauses, cues, and where blanks may stand.

Letters are rows (project_id, pos, text, key, start_ms, end_ms): `key` is the letter in lower
case, `pos` its place among the letters and digits of the project. Work is keyed by project.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cuespan.functions.text import CAPTION_PUNCTUATION, letters as letters_of, norm_text, visible_length
from cuespan.operators import alignment as A
from cuespan.operators.folds import clause_atoms, pack_words
from cuespan.operators.frames import char_timing
from cuespan.operators.rules import violations

# Words a long clause is rather cut before, and letters a caption should not end or start with.
CONNECTORS = ("但是", "不过", "所以", "因此", "同时", "而且", "然后", "另外", "其实", "也可能", "或者", "再加上", "想停")
BAD_ENDINGS = ("的", "地", "得", "和", "与", "或", "及", "但", "却", "而", "把", "被", "给", "在", "从", "向")
BAD_STARTS = ("的", "地", "得", "和", "与", "或", "及", "但", "却", "而")
# Of a cut, the worth of a pause's millisecond, of a connector and of each letter short of the longest piece.
PAUSE_WORTH, CONNECTOR_WORTH, SHORT_COST = 3, 900, 12
# Letters below which two clauses rather stay together.
FEW_BEFORE, FEW_AFTER = 5, 4
#: Letters that are white space, and punctuation but for the underscore, in the syntax of Java and RE2.
BLANK, PUNCTUATION = r"[\p{Z}\t\n\x0B\f\r]", r"[^\P{P}_]"


#: Letters that a task sorts at once, about: their rows are many times larger than what is shuffled of them.
LETTERS_A_TASK = 500_000


def tasks_for(letters: int | None) -> int:
    return max(1, -(-(letters or 0) // LETTERS_A_TASK))


def script_letters(scripts: DataFrame) -> DataFrame:
    """(project_id, pos, text, key) of scripts (project_id, text): their letters and digits in order."""
    return scripts.select("project_id", F.posexplode(letters_of("text")).alias("pos", "text")).withColumn("key", F.lower("text"))


def timed_letters(words: DataFrame) -> DataFrame:
    """(project_id, pos, key, start_ms, end_ms) of words (project_id, idx, text, start_ms, end_ms)."""
    df = char_timing(words)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("idx", "pos")) - 1
    return df.select("project_id", place.alias("pos"), F.col("char").alias("key"), "start_ms", "end_ms")


def project_rows(tasks: int | None = None, **kinds: DataFrame | None) -> DataFrame:
    """Scripts' texts, recognised words and clauses as rows of one table, sorted by project, kind and place; rows that lie by project already stay.

    script and spoken: project_id, _i, text and, if spoken, a and b, the times; clause: project_id,
    _i, text, marks (the text with NUL for all but letters and digits), a, b and major. Dealt to `tasks` if that is given.
    """
    parts = [df.dropna(subset=["project_id"]).withColumn("_kind", F.lit(n)) for n, df in ((A.SCRIPT, kinds.get("script")), (A.SPOKEN, kinds.get("spoken")), (A.CLAUSE, kinds.get("clause"))) if df is not None]
    kind = {"_i": "bigint", "text": "string", "marks": "string", "a": "bigint", "b": "bigint", "major": "boolean"}
    full = [df.select("project_id", "_kind", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kind.items()]) for df in parts]
    rows = functools.reduce(DataFrame.union, [df.repartition(tasks, "project_id") if tasks else df for df in full])
    # The window asks for a project's rows in one task, whatever way they came; the sort is the window's own.
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("project_id").orderBy("_kind", "_i")))
    return rows.sortWithinPartitions("project_id", "_at").drop("_at")


def _clauses(atoms: DataFrame) -> DataFrame:
    marks = F.regexp_replace("text", r"[^\p{L}\p{N}_]", "\0")
    return atoms.select("project_id", F.col("atom_no").alias("_i"), "text", marks.alias("marks"), F.col("start_idx").alias("a"), F.col("end_idx").alias("b"), "major")


def _texts(df: DataFrame, *more) -> DataFrame:
    """Texts without what is no letter or digit."""
    return df.select("project_id", *more, F.regexp_replace("text", r"[^\p{L}\p{N}_]", "").alias("text"))


def _spoken(words: DataFrame) -> DataFrame:
    return _texts(words, F.col("idx").alias("_i"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))


def _aligned(rows: DataFrame, split: bool, k: int, slack: int) -> DataFrame:
    kind = dict(rows.dtypes)["project_id"]
    return rows.mapInArrow(functools.partial(A.align_rows, split=split, k=k, slack=slack), f"project_id {kind}, pos int, text string, key string, start_ms bigint, end_ms bigint")


def align_script(script: DataFrame, recognized: DataFrame, k: int = 12, slack: int = 40) -> DataFrame:
    """The script's letters with times: (project_id, pos, text, key, start_ms, end_ms).

    Letters in a run of k or more that stands once in script and recognition take the recognised
    times. A run of others is spread evenly over the recognised letters between its neighbours, or
    if there are none over the time between them. Then starts and ends never go back. Projects
    without recognised letters have no rows. Tasks grow in number with the script's letters, not in size.
    """
    spoken = recognized.select("project_id", F.col("pos").alias("_i"), F.col("key").alias("text"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    rows = project_rows(tasks_for(script.count()), script=script.select("project_id", F.col("pos").alias("_i"), "text"), spoken=spoken)
    return _aligned(rows, False, k, slack)


def align_texts(scripts: DataFrame, words: DataFrame, k: int = 12, slack: int = 40) -> DataFrame:
    """`align_script` of whole texts, scripts (project_id, text) and words (project_id, idx, text, start_ms, end_ms): no letter is a row before it has its times."""
    return _aligned(project_rows(script=_texts(scripts, F.lit(0).alias("_i")), spoken=_spoken(words)), True, k, slack)


def _pieces(rows: DataFrame, work: Callable, max_chars: int, max_ms: int, connectors: tuple[str, ...], **more) -> DataFrame:
    kind = dict(rows.dtypes)["project_id"]
    how = dict(max_chars=max_chars, max_ms=max_ms, connectors=tuple(connectors), worth=(PAUSE_WORTH, CONNECTOR_WORTH, SHORT_COST), **more)
    out = rows.mapInArrow(functools.partial(work, **how), f"project_id {kind}, atom_no int, piece_no int, text string, start_idx bigint, end_idx bigint, major boolean, start_ms bigint, end_ms bigint")
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def split_long_atoms(atoms: DataFrame, letters: DataFrame, max_chars: int = 18, max_ms: int = 3600, connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """Clauses (project_id, atom_no, text, start_idx, end_idx, major) cut where they are too long: adds piece_no, start_ms and end_ms.

    A piece has at most max_chars letters and max_ms of time, one letter at least. It ends where
    pause, connector and length together are worth most, the later place on a tie. Only the last
    piece of a clause ends a sentence. Clauses beyond the aligned letters are left out.
    """
    tasks = tasks_for(atoms.agg(F.sum(F.col("end_idx") - F.col("start_idx"))).first()[0])
    spoken = letters.select("project_id", F.col("pos").alias("_i"), F.col("key").alias("text"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    return _pieces(project_rows(tasks, spoken=spoken, clause=_clauses(atoms)), A.piece_rows, max_chars, max_ms, connectors)


def script_pieces(scripts: DataFrame, words: DataFrame, max_chars: int = 18, max_ms: int = 3600, k: int = 12, slack: int = 40, connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """`split_long_atoms` of the scripts' clauses on the words' times: no letter is ever a row."""
    rows = project_rows(script=_texts(scripts, F.lit(0).alias("_i")), spoken=_spoken(words), clause=_clauses(clause_atoms(scripts)))
    return _pieces(rows, A.script_piece_rows, max_chars, max_ms, connectors, k=k, slack=slack)


def pack_sentence(pieces: DataFrame, max_chars: int = 18, max_ms: int = 3600) -> DataFrame:
    """(project_id, group_no, start_idx, end_idx, start_ms, end_ms, text): pieces of a sentence joined while one of them is very short.

    A piece joins the group before if either has few letters, the group doesn't end with a colon,
    and both together are short enough.
    """
    w = Window.partitionBy("project_id").orderBy("start_idx")
    df = pieces.withColumns({"sentence": F.coalesce(F.sum(F.col("major").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_colon": F.regexp_like("text", F.lit(r"[：:]\s*$"))})
    # A group only depends on the group before within its sentence: sentences are folded, each for itself.
    item = F.struct(F.col("start_idx").alias("s"), F.col("end_idx").alias("e"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.col("_colon").alias("colon"), "text")
    rows = df.groupBy("project_id", "sentence").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kind = f"array<{dict(rows.dtypes)['rows'][6:-1]}>"

    def fold(groups: Column, x: Column) -> Column:
        g = F.try_element_at(groups, F.lit(-1))
        few = (g["e"] - g["s"] < FEW_BEFORE) | (x["e"] - x["s"] < FEW_AFTER)
        together = few & ~g["colon"] & (x["e"] - g["s"] <= max_chars) & (x["b"] - g["a"] <= max_ms)
        both = F.struct(g["s"].alias("s"), x["e"].alias("e"), g["a"].alias("a"), x["b"].alias("b"), x["colon"].alias("colon"), F.concat(g["text"], x["text"]).alias("text"))
        return F.when(F.coalesce(together, F.lit(False)), F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(both))).otherwise(F.concat(groups, F.array(x)))

    df = rows.select("project_id", F.explode(F.aggregate("rows", F.array().cast(kind), fold)).alias("g"))
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("g.s")) - 1
    return df.select("project_id", number.alias("group_no"), F.col("g.s").alias("start_idx"), F.col("g.e").alias("end_idx"), F.col("g.a").alias("start_ms"), F.col("g.b").alias("end_ms"), "g.text")


def build_cues(scripts: DataFrame, words: DataFrame, max_chars: int = 18, max_ms: int = 3600, k: int = 12) -> DataFrame:
    """(project_id, cue_no, start_ms, end_ms, text): captions from the script's clauses on recognised times.

    scripts: project_id, text; words: project_id, idx, text, start_ms, end_ms. Projects whose script
    has no letter, or no row, get captions packed from the words alone.
    """
    groups = pack_sentence(script_pieces(scripts, words, max_chars, max_ms, k), max_chars, max_ms)
    text = F.trim(F.regexp_replace(F.trim(F.translate("text", CAPTION_PUNCTUATION, "")), "[ \t]+", " "))
    cues = groups.select("project_id", (F.col("group_no") + 1).alias("cue_no"), "start_ms", "end_ms", text.alias("text"))
    spoken = scripts.where(visible_length("text") > 0).select("project_id")
    return cues.unionByName(pack_words(words.join(spoken, "project_id", "left_anti"), max_chars, max_ms))


def punctuation_offsets(scripts: DataFrame) -> DataFrame:
    """(project_id, at): how many letters of the script stand before each of its punctuation marks; none at the start."""
    parts = scripts.select("project_id", F.posexplode_outer(F.split("text", PUNCTUATION)).alias("i", "part"))
    w = Window.partitionBy("project_id").orderBy("i")
    df = parts.withColumns({"at": F.sum(visible_length("part")).over(w), "_more": F.lead("i").over(w).isNotNull()})
    return df.where("_more and at > 0").select("project_id", "at").distinct()


def caption_space_check(cues: DataFrame, scripts: DataFrame) -> DataFrame:
    """(project_id, cue_no, at, rule_id): blanks in captions where the script has no punctuation, but for those between ASCII words.

    `at` counts the project's letters before the blank. cues: project_id, cue_no, text.
    """
    w = Window.partitionBy("project_id").orderBy("cue_no")
    start = F.coalesce(F.sum(visible_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cues.withColumn("_start", start).select("project_id", "cue_no", "_start", F.posexplode_outer(F.split("text", BLANK)).alias("i", "part"))
    inside = Window.partitionBy("project_id", "cue_no").orderBy("i")
    df = parts.withColumns({"at": F.col("_start") + F.sum(visible_length("part")).over(inside), "_next": F.lead("part").over(inside)})
    ascii_words = F.regexp_like("part", F.lit("[A-Za-z0-9]$")) & F.regexp_like("_next", F.lit("^[A-Za-z0-9]"))
    blanks = df.where(F.col("_next").isNotNull() & ~ascii_words).select("project_id", "cue_no", "i", "at")
    # Blanks and punctuation meet as rows of one table: those that lie by project already aren't shuffled by their place.
    marks = punctuation_offsets(scripts).dropna().withColumn("_mark", F.lit(True))
    both = blanks.unionByName(marks, allowMissingColumns=True).withColumn("_any", F.max("_mark").over(Window.partitionBy("project_id", "at")))
    return both.where("_any is null").select("project_id", "cue_no", "at", F.lit("blank-without-punctuation").alias("rule_id"))


def caption_contract(cues: DataFrame, scripts: DataFrame, max_chars: int = 18) -> DataFrame:
    """(project_id, cue_no, rule_id, severity): what captions owe their script; cue_no is null for a project's own.

    Errors: texts that together differ from the script's letters and digits, several lines, punctuation,
    and blanks without punctuation in the script. Warnings: particles at the end or the start, too many letters.
    """
    said = cues.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("cue_no", norm_text("text", "casefold").alias("t"))))["t"], "").alias("_said"))
    differs = scripts.join(said, "project_id").where(norm_text("text", "casefold") != F.col("_said"))
    differs = differs.select("project_id", F.lit(None).cast(dict(cues.dtypes)["cue_no"]).alias("cue_no"), F.lit("text-differs").alias("rule_id"), F.lit("error").alias("severity"))
    compact = F.trim(F.regexp_replace("text", "\n", ""))
    soft = {"ends-in-particle": F.right(compact, F.lit(1)).isin(*BAD_ENDINGS), "starts-with-particle": F.left(compact, F.lit(1)).isin(*BAD_STARTS), "too-many-letters": visible_length("text") > max_chars}
    hard = {"several-lines": F.contains("text", F.lit("\n")), "punctuation": F.regexp_like("text", F.lit(r"\p{P}"))}
    found = violations(cues, ["project_id", "cue_no"], hard | soft).drop("value").withColumn("severity", F.when(F.col("rule_id").isin(*soft), "warning").otherwise("error"))
    blanks = caption_space_check(cues, scripts).select("project_id", "cue_no", "rule_id", F.lit("error").alias("severity")).distinct()
    return differs.union(found).union(blanks)
