"""Text columns: tokens, cleaners, prompts and score parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

# Patterns that find a score in a judge's answer, most trusted first.
SCORE_PATTERNS = [
    r"<(\d+\.?\d*?)>",
    r"(\d+\.?\d*?) out of 10",
    r"<(\d+\.?\d*?)",
    r"Score: (\d+\.?\d*?)",
    r"a score of (\d+\.?\d*?)",
    r"Overall Score \((\d+\.?\d*?)/10\)",
    r"<(\d+\.?\d*?)/30>",
    r"\s(\d+\.?\d*?)>",
]
SCORE_PATTERNS_LLAMA = [
    r"<(\d+\.?\d*?)>",
    r"(\d+\.?\d*?) out of 10",
    r" (\d+\.?\d*?)>",
    r"<(\d+\.?\d*?) ",
    r"a score of (\d+\.?\d*?)",
    r"Overall Score \((\d+\.?\d*?)/10\)",
    r"<(\d+\.?\d*?)/30>",
    r"R(\d+\.?\d*?)>",
    r"= (\d+\.?\d*?)",
    r"≈ (\d+\.?\d*?)",
    r"(\d+\.?\d*?) out of ",
    r"score is (\d+\.?\d*?)",
    r"score is: (\d+\.?\d*?)",
    r"Total score (\d+\.?\d*?)",
    r"Total score: (\d+\.?\d*?)",
    r"Score: (\d+\.?\d*?)",
    r"score: (\d+\.?\d*?)",
    r"is (\d+\.?\d*?)",
]

# Prompts put to a judge, with places for type, information and instruction.
_ASK = (
    "You are tasked with evaluating the consistency between a {made} navigation instruction and the {type} information "
    "along the navigation path. Assign a score between 0 and 10, where a higher score indicates better consistency.\n\n"
    "Here is the information and instruction:\n\n[Information]\n{info}\n[Instruction]\n{instruction}\n\n"
)
PROMPTS = {
    "plain": _ASK.replace("{made}", "summarized")
    + "Please provide your final score in a new line surrounded by angle brackets, e.g., <5>.\n\n",
    "cot": _ASK.replace("{made}", "generated")
    + "Please provide your evaluation and score. Write your final score in a new line surrounded by angle brackets, e.g., <5>.\n\n",
    "llama": _ASK.replace("{made}", "summarized")
    + "Please provide your final score between 0 and 10 on a new line, in the exact form like '<5>'. The score must be a "
    "number with no other characters or calculations, and it must be surrounded by angle brackets.\n\n",
}
LIST_HEADER = "\nHere is the list:\n"

# Opening phrases dropped from an object description, in this order.
LEAD_INS = [
    "The most significant object is ",
    "There is ",
    "The most significant object in the image is ",
    "The nearest object is ",
]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, and single other characters."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), 0)


def token_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(TOKEN))


def path_part(path: Column | str, n: int) -> Column:
    """n-th path part from the end, counting from 1."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-n))


def episode_key(path: Column | str) -> dict[str, Column]:
    """source, split, episode and instruction id of `.../source/split/episode/alias/id.ext`."""
    return {
        "source": path_part(path, 5), "split": path_part(path, 4), "episode_id": path_part(path, 3),
        "inst_alias": path_part(path, 2), "inst_id": F.regexp_replace(path_part(path, 1), r"(.)\.[^.]*$", "$1"),
    }


def swap_alias(path: Column | str, alias: str) -> Column:
    """Replace the second-last part of the path."""
    quoted = alias.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(_c(path), r"[^/]+/([^/]+)$", f"{quoted}/$1")


def join_values(values: Column | str) -> Column:
    """Lower-cased, trimmed values joined by `"; "`; empty if any value is missing."""
    values = _c(values)
    text = F.array_join(F.transform(values, lambda v: _strip(F.lower(v))), "; ")
    return F.when(F.exists(values, lambda v: v.isNull()), "").otherwise(text)


def build_prompt(info_type: Column | str, info: Column | str, instruction: Column | str, template: str = "plain") -> Column:
    """Fill a judge prompt; the llama form puts the instruction on one line."""
    inst = F.replace(_c(instruction), F.lit("\n"), F.lit(" ")) if template == "llama" else _c(instruction)
    head, rest = PROMPTS[template].split("{type}")
    mid, rest = rest.split("{info}")
    low, tail = rest.split("{instruction}")
    return F.concat(F.lit(head), F.lower(_c(info_type)), F.lit(mid), _c(info), F.lit(low), inst, F.lit(tail))


def build_list_prompt(system: str, items: Column | str) -> Column:
    """System prompt, header and the items numbered from 0, one per line."""
    lines = F.transform(_c(items), lambda v, i: F.concat(i.cast("string"), F.lit(" "), v))
    return F.concat(F.lit(system + LIST_HEADER), F.array_join(lines, "\n"))


def extract_score(response: Column | str, patterns: Sequence[str] = SCORE_PATTERNS) -> Column:
    """Last match of the first pattern that matches; 5 without a match or above 10."""
    text = F.regexp_replace(F.regexp_replace(_c(response), r'["*]', ""), r"^[^\n:]*:", "")
    found = [F.try_element_at(F.regexp_extract_all(text, F.lit(p), 1), F.lit(-1)) for p in patterns]
    score = F.coalesce(*found).try_cast("double")
    return F.when(score > 10, 5.0).otherwise(F.coalesce(score, F.lit(5.0)))


def _unlist(c: Column) -> Column:
    for pattern, by in ((r"\.+\s*\n\d\.\s*", ". "), (r"\.+\s*\n\-\s*", ". "), (r"^\-\s*", ""), (r"^\d\.\s*", ""),
                        (r"\n\d\.\s*", ""), (r"\*", "")):
        c = F.regexp_replace(_strip(c) if pattern == r"\.+\s*\n\d\.\s*" else c, pattern, by)
    return _strip(F.replace(c, F.lit("The most significant object is a"), F.lit("A")))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**30)))


def _after(c: Column, mark: str) -> Column:
    """Text between the first and the second occurrence of the mark; null without one."""
    return F.get(F.split(c, mark.replace("[", r"\[").replace("]", r"\]")), F.lit(1))


def clean_answer(answer: Column | str, kind: str) -> Column:
    """Text cleaners for model answers, by kind."""
    c = _c(answer)
    if kind == "unlist":
        return _unlist(c)
    if kind == "lead_in":
        for phrase in LEAD_INS:
            c = F.replace(c, F.lit(phrase), F.lit(""))
        return _capital(c)
    if kind == "summary":
        return _strip(F.regexp_replace(F.replace(c, F.lit('"'), F.lit("")), r"^[^\n:]*:", ""))
    if kind == "prefix":
        return F.regexp_replace(_strip(c), r"^[^\n:]*:", "")
    if kind == "inst":
        return _after(c, "[/INST]")
    if kind == "inst_unlist":
        return _unlist(_after(c, "[/INST]"))
    if kind == "assistant":
        return _strip(_after(c, "ASSISTANT:"))
    if kind == "brackets":
        m = F.regexp_extract_all(c, F.lit(r"<([^\n]*?)>"), 1)
        return F.coalesce(F.get(m, F.lit(0)), F.lit("None"))
    if kind == "sentence":
        return F.concat(_strip(c), F.lit("."))
    if kind == "answer":
        return clean_answer(split_reasoning(c)["answer"], "summary")
    if kind == "reasoning":
        return split_reasoning(c)["reasoning"]
    raise ValueError(f"unknown cleaner {kind}")


def split_reasoning(answer: Column | str, mark: str = "</think>") -> dict[str, Column]:
    """Reasoning up to the last closing mark and the answer behind it, without outer newlines."""
    c = _c(answer)
    at = F.length(c) - F.length(F.substring_index(c, mark, -1))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\n+", ""), r"\n+$", "")
    thought = F.replace(F.replace(F.substring(c, F.lit(1), at), F.lit(mark), F.lit("")), F.lit("<think>"), F.lit(""))
    return {"reasoning": bare(thought), "answer": bare(F.substring_index(c, mark, -1))}


def clean_sentences(text: Column | str) -> Column:
    """Close gaps before marks, capitalise each finished sentence, drop what is unfinished."""
    t = F.regexp_replace(_strip(_c(text)), r"\s+([.,!?])", "$1")
    # cutting behind the marks is linear; a pattern for whole sentences would rescan an unfinished tail
    pieces = F.filter(F.split(t, r"(?<=[.!?])"), lambda s: F.substring(s, -1, 1).isin(".", "!", "?"))
    parts = F.transform(pieces, lambda s: _capital(_strip(s)))
    return F.array_join(F.filter(parts, lambda s: s != ""), " ")


def data_url(content: Column | str) -> Column:
    """Image bytes as a JPEG data URL."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.replace(F.base64(_c(content)), F.lit("\r\n"), F.lit("")))
