"""Scalar column functions.

All of them return ``Column`` expressions built from ``pyspark.sql.functions``
(higher-order array functions included), so they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Text markers that model outputs and prompts use.  They must be
# equal to the markers of the data being parsed.
QUESTION_MARK = "Question:"
ANSWER_MARK = "Answer:"
LONG_ANSWER_MARK = "Long Answer:"
CONCLUSION_MARK = "Conclusion:"
CONCLUSION_SPLIT = "Conclusion: "
BLOCK_SEP = "\n\n"
# ---------------------------------------------------------------------------

# Characters Python's ``str.strip()`` removes beyond Java's Unicode \s.
_WS = r"[\s\x1c-\x1f]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_REGEX_META = set(".$|()[{^?*+\\")


def quote(literal: str) -> str:
    """Java regex that matches ``literal`` verbatim (Spark ``split`` takes a regex).

    A single non-meta character is passed as is: ``String.split`` then takes
    its no-regex fast path."""
    if len(literal) == 1 and literal not in _REGEX_META:
        return literal
    if "\\E" in literal:
        return "".join("\\" + ch if not ch.isalnum() else ch for ch in literal)
    return "\\Q" + literal + "\\E"


def split_lit(c, sep: str) -> Column:
    """Python ``str.split(sep)``: literal separator, empty parts kept."""
    return F.split(col(c), quote(sep), -1)


def count_parts(c, sep: str) -> Column:
    """``len(text.split(sep))`` for a one-character separator, without
    building the array: occurrences + 1 (null stays null)."""
    assert len(sep) == 1
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(sep), F.lit(""))) + 1


def strip(c) -> Column:
    """Python ``str.strip()`` (F13): Spark ``trim`` only removes spaces."""
    return F.regexp_replace(col(c), r"(?U)\A" + _WS + r"+|" + _WS + r"+\z", "")


def is_blank(c) -> Column:
    """Null, or nothing left after :func:`strip`."""
    return col(c).isNull() | (strip(c) == "")


def word_count(c) -> Column:
    """``len(text.split())``."""
    words = F.filter(F.split(col(c), r"(?U)" + _WS + "+"), lambda x: x != "")
    return F.when(col(c).isNotNull(), F.size(words).cast("long"))


def char_count(c) -> Column:
    """``len(text)`` in code points."""
    return F.length(col(c)).cast("long")


def first_lines(c, n: int = 2) -> Column:
    """First ``n`` newline-separated parts re-joined."""
    return F.substring_index(col(c), "\n", n)


def render(template: str, mapping: dict) -> Column:
    """Replace each ``[MARKER]`` of ``template`` by a column value.

    Literal replacement in mapping order, like chained ``str.replace``; a null
    value makes the result null.
    """
    out = F.lit(template)
    for marker, value in mapping.items():
        out = F.replace(out, F.lit(marker), col(value))
    return out


def replace_all(c, pairs) -> Column:
    """Chained literal ``str.replace`` for each (search, replacement)."""
    out = col(c)
    for search, repl in pairs:
        out = F.replace(out, F.lit(search), F.lit(repl))
    return out


def first_output(c) -> Column:
    """String stays, list gives its first item, empty list gives null."""
    return F.get(col(c), 0)


def parse_qa_blocks(c) -> Column:
    """``array<struct<block, question, answer>>`` of the well-formed QA blocks.

    A block (split on a blank line) counts when it holds both markers; the
    question is the text after the first ``Question:`` up to the next
    ``Answer:``; the answer is the text between the first and the second
    ``Answer:``.  Both stripped, both non-empty.  Use with ``F.inline``.
    """
    blocks = split_lit(c, BLOCK_SEP)

    def one(b, i):
        q = strip(F.get(split_lit(F.get(split_lit(b, QUESTION_MARK), 1), ANSWER_MARK), 0))
        a = strip(F.get(split_lit(b, ANSWER_MARK), 1))
        ok = b.contains(QUESTION_MARK) & b.contains(ANSWER_MARK) & (q != "") & (a != "")
        return F.struct(i.cast("long").alias("block"), q.alias("question"), a.alias("answer"),
                        ok.alias("ok"))

    parsed = F.filter(F.transform(blocks, one), lambda s: s["ok"])
    return F.transform(parsed, lambda s: F.struct(s["block"].alias("block"),
                                                  s["question"].alias("question"),
                                                  s["answer"].alias("answer")))


def parse_question_answer_conclusion(c) -> Column:
    """struct(question, long_answer, answer) or null when malformed.

    Exactly one ``Long Answer:``; after it exactly one ``Conclusion:``; before
    it exactly one ``Question:``.  The conclusion is stripped and lower-cased.
    """
    parts = split_lit(c, LONG_ANSWER_MARK)
    ans = split_lit(F.get(parts, 1), CONCLUSION_MARK)
    iq = split_lit(F.get(parts, 0), QUESTION_MARK)
    good = (F.size(parts) == 2) & (F.size(ans) == 2) & (F.size(iq) == 2)
    return F.when(good, F.struct(
        strip(F.get(iq, 1)).alias("question"),
        strip(F.get(ans, 0)).alias("long_answer"),
        F.lower(strip(F.get(ans, 1))).alias("answer"),
    ))


def conclusion_tail(c) -> Column:
    """Text after the last ``Conclusion: `` (the whole text when absent)."""
    return F.element_at(split_lit(c, CONCLUSION_SPLIT), -1)


def conclusion_ok(c) -> Column:
    """the conclusion part contains ``yes`` or ``no`` (case-sensitive)."""
    tail = conclusion_tail(c)
    return tail.contains("yes") | tail.contains("no")


def binarize(c) -> Column:
    """first line, lower-cased; yes/1 -> 1, no/0 -> 0, blank -> null, else 0.

    Substring tests on purpose (so ``know`` counts as ``no``), as in the probe
    scoring this reproduces.
    """
    x = F.get(split_lit(F.lower(col(c)), "\n"), 0)
    return (F.when(x.contains("yes") | x.contains("1"), F.lit(1))
            .when(x.contains("no") | x.contains("0"), F.lit(0))
            .when(x.isNull() | (strip(x) == ""), F.lit(None).cast("int"))
            .otherwise(F.lit(0)))


def caption_of(c, marker: str) -> Column:
    """text after the caption marker."""
    return F.get(split_lit(c, marker), 1)


def argmax(c) -> Column:
    """F8: 0-based index of the first maximum; null for null/empty arrays."""
    return (F.array_position(col(c), F.array_max(col(c))) - 1).cast("int")


def round_half_even(c, digits: int = 0) -> Column:
    """banker's rounding (numpy / pandas ``round``)."""
    return F.bround(col(c), digits)


def model_tail(c) -> Column:
    """name after the last ``/``."""
    return F.substring_index(col(c), "/", -1)


def model_family(c, known) -> Column:
    """first known base-model name contained in the name, else null."""
    return F.coalesce(*[F.when(col(c).contains(k), F.lit(k)) for k in known], F.lit(None))


def instruction_format(instruction, inp, input_label: str = "\nInput: ",
                       output_cue: str = "\nOutput: ") -> Column:
    """Instruction + (blank input -> nothing, else labelled line) + cue."""
    extra = F.when(is_blank(inp), F.lit("")).otherwise(F.concat(F.lit(input_label), col(inp)))
    return F.concat(col(instruction), extra, F.lit(output_cue))


def zero_shot(question, question_word: str = "Question", response_word: str = "Output") -> Column:
    """``"{Q}: " + question + "\\n{R}: "``."""
    return F.concat(F.lit(f"{question_word}: "), col(question), F.lit(f"\n{response_word}: "))


def choose_by_label(label, first, second) -> Column:
    """Label 1 picks the second option, anything else the first."""
    return F.when(col(label) == 1, col(second)).otherwise(col(first))


def strip_carriage_return(c) -> Column:
    """Remove every ``\\r``."""
    return F.replace(col(c), F.lit("\r"), F.lit(""))


def swap_stop_strings(c, stops, eos: str) -> Column:
    """Each stop string becomes ``" " + eos + " "``."""
    return replace_all(c, [(s, f" {eos} ") for s in stops])


def strip_stop_strings(c, stops) -> Column:
    """Delete every stop string from every generated sequence."""
    return F.transform(col(c), lambda x: replace_all(x, [(s, "") for s in stops]))


def cut_at_stop(c, stop: str) -> Column:
    """Text before the first stop marker, stripped."""
    return strip(F.substring_index(col(c), stop, 1))


def padded_path(id_col, directory: str, width: int = 20, ext: str = ".png") -> Column:
    """``directory/<id zero-padded to width><ext>``."""
    return F.concat(F.lit(directory.rstrip("/") + "/"),
                    F.lpad(col(id_col).cast("string"), width, "0"), F.lit(ext))


def rebase_path(c, marker: str, directory: str) -> Column:
    """Replace everything before ``marker`` by ``directory``; exactly one
    marker is required, otherwise null."""
    parts = split_lit(c, marker)
    return F.when(F.size(parts) == 2,
                  F.concat(F.lit(directory), F.lit(marker), F.get(parts, 1)))


def prompt_completion(inp, out=None, prompt_suffix: str = " \n",
                      completion_prefix: str = "Output: ") -> tuple[Column, Column]:
    """prompt/completion pair; completion is ``""`` without an output."""
    prompt = F.concat(col(inp), F.lit(prompt_suffix))
    if out is None:
        return prompt, F.lit("")
    return prompt, F.concat(F.lit(completion_prefix), col(out))


def preference_prompt(inp, chosen, rejected, prompt_suffix: str = " \n",
                      completion_prefix: str = "Output: ") -> tuple[Column, Column, Column]:
    """P15, preference form: prompt and both labelled completions."""
    prompt, good = prompt_completion(inp, chosen, prompt_suffix, completion_prefix)
    return prompt, good, prompt_completion(inp, rejected, prompt_suffix, completion_prefix)[1]


def correct_flag(output, gold, marker: str = CONCLUSION_MARK) -> Column:
    """Last segment after the marker, stripped and lower-cased, equals gold."""
    return (F.lower(strip(F.substring_index(col(output), marker, -1)))
            == F.lower(strip(col(gold)))).cast("int")


def sample_text(inp, out=None, completion_prefix: str = "Output: ") -> Column:
    """Prompt, newline, labelled completion; the prompt alone without one."""
    prompt, completion = prompt_completion(inp, out, completion_prefix=completion_prefix)
    return prompt if out is None else F.concat(prompt, F.lit("\n"), completion)


def chat_template(c, family: str, templates: dict) -> Column:
    """Wrap text for an image-chat model family.  ``templates`` maps a
    family to (prefix, suffix, tag_to_remove or None); unknown families raise."""
    if family not in templates:
        raise ValueError(f"unsupported family {family!r}")
    prefix, suffix, tag = templates[family]
    body = col(c) if tag is None else F.replace(col(c), F.lit(tag), F.lit(""))
    return F.concat(F.lit(prefix), body, F.lit(suffix))
