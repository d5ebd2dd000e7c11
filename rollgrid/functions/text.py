"""Parsing of model outputs: trajectories, action tokens, answers and chat rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d*\.?\d+"
TRIPLE = rf"[\(\[]\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*[\)\]]"
PAIR = rf"\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]"


def triples(text: Column) -> Column:
    """All (x, y, yaw) of a text as array<struct<x, y, yaw>>; malformed ones are passed over."""
    parts = [F.regexp_extract_all(text, F.lit(TRIPLE), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("a", "b", "c"))]), lambda z: F.struct(z["a"].cast("double").alias("x"), z["b"].cast("double").alias("y"), z["c"].cast("double").alias("yaw")))


def pairs(text: Column) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(PAIR), F.lit(i)) for i in (1, 2)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.struct(z["0"].cast("double").alias("x"), z["1"].cast("double").alias("y")))


def first_n(items: Column, n: int) -> Column:
    """The first n of an array, NULL where it has fewer."""
    return F.when(F.size(items) >= n, F.slice(items, 1, n))


def after_last(text: Column, tag: str) -> Column:
    """What follows the last occurrence of a tag; NULL without it."""
    return F.when(F.contains(text, F.lit(tag)), F.substring_index(text, tag, -1))


def after_first(text: Column, tag: str) -> Column:
    at = F.locate(tag, text)
    return F.when(at > 0, F.substring(text, at + len(tag), F.length(text)))


def tagged_trajectory(text: Column, tag: str = '"future_trajectory"', n: int = 8) -> Column:
    """The first n triples of the first list after the last tag, NULL where there are fewer."""
    inside = F.regexp_extract(after_last(text, tag), r"(?s)\[(.*?)\]", 1)
    return first_n(triples(inside), n)


def keyword_trajectory(text: Column, keyword: str) -> Column:
    """All triples after the first keyword; without it none."""
    return F.coalesce(triples(after_first(text, keyword)), triples(F.lit("")))


def planned_pairs(text: Column, n: int = 8) -> Column:
    """The first n [x, y] inside <PLANNING>, or in the whole text where it has no such part; NULL if fewer."""
    inside = F.regexp_extract(text, r"(?s)<PLANNING>(.*?)</PLANNING>", 1)
    return first_n(pairs(F.when(inside != "", inside).otherwise(text)), n)


def action_ids(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<action_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def json_body(text: Column) -> Column:
    """The text without a fence of three back quotes around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def json_trajectory(text: Column) -> Column:
    """struct(explanation, trajectory, parsed_ok) of a JSON answer, fenced or not; bad JSON gives parsed_ok = false."""
    body = F.from_json(json_body(text), "explanation string, trajectory string, future_trajectory string", {"mode": "PERMISSIVE"})
    trajectory = F.coalesce(body["trajectory"], body["future_trajectory"])
    return F.struct(body["explanation"].alias("explanation"), triples(trajectory).alias("trajectory"), F.coalesce(F.size(triples(trajectory)) > 0, F.lit(False)).alias("parsed_ok"))


def last_answer(text: Column) -> Column:
    """What follows the last 'Answer:' on its line."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


#: Literal replacements of answer normalisation, in order. Fixed values.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
#: Expressions removed from answers. Fixed values.
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm",
    "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]


#: Patterns that unwrap marked-up answers, in order. Fixed values.
UNWRAPPED = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", "\\$$3\\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
]


def normalised_answer(answer: Column) -> Column:
    """A final answer in the form in which answers are compared."""
    out = F.substring_index(answer, "=", -1)
    for old, new in SUBSTITUTIONS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for old in REMOVED:
        out = F.replace(out, F.lit(old), F.lit(""))
    for pattern, to in UNWRAPPED:
        out = F.regexp_replace(out, pattern, to)
    out = F.replace(out, F.lit("$"), F.lit(""))
    plain = F.when(F.replace(out, F.lit(","), F.lit("")).rlike(r"^\d+$"), F.replace(out, F.lit(","), F.lit(""))).otherwise(out)
    return F.regexp_replace(plain, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def answer_reward(response: Column, truth: Column, tail: int = 300) -> Column:
    """1 where the last answer of the last characters equals the truth, else -1."""
    got = normalised_answer(F.coalesce(last_answer(F.right(response, F.lit(tail))), F.lit("[INVALID]")))
    return F.when(got == normalised_answer(truth), F.lit(1.0)).otherwise(F.lit(-1.0))


def boxed_format(response: Column) -> Column:
    return response.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")


def tagged_format(response: Column) -> Column:
    return response.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$").cast("double")


def tagged_answer(response: Column) -> Column:
    """The inside of <answer>, or the whole text, trimmed."""
    inside = F.regexp_extract(response, r"(?s)<answer>(.*?)</answer>", 1)
    return F.trim(F.when(inside != "", inside).otherwise(response))


def weighted_reward(accuracy: Column, fmt: Column, weight: float) -> Column:
    return (1 - weight) * accuracy + weight * fmt


def choice_digit(response: Column) -> Column:
    """An answer that is exactly one digit, else the first 0, 1 or 2 in it; NULL if there is none."""
    plain = F.trim(response)
    found = F.regexp_extract(plain, "[012]", 0)
    return F.when(plain.rlike(r"^\d$"), plain).when(found != "", found)


def signed(x: Column) -> Column:
    """+1.23 style with two decimals; what rounds to nothing is 0.0."""
    return F.when(F.abs(x) < 0.005, F.lit("0.0")).otherwise(F.format_string("%+.2f", x))


def format_points(parsed: Column) -> Column:
    """0.4 for a parsed answer, 0.4 for both keys, 0.1 for a list, 0.1 for a non-empty one; ``parsed`` as json_trajectory gives it."""
    has = lambda c: c.isNotNull().cast("double")
    keys = has(parsed["explanation"]) * has(parsed["trajectory"])
    return 0.4 * parsed.isNotNull().cast("double") + 0.4 * keys + 0.1 * has(parsed["trajectory"]) + 0.1 * F.coalesce((F.size(parsed["trajectory"]) > 0).cast("double"), F.lit(0.0))


def last_turn(conversation: Column, speaker: str) -> Column:
    """The text of the last turn of a speaker in array<struct<from, value>>."""
    turns = F.filter(conversation, lambda t: t["from"] == speaker)
    return F.try_element_at(turns, F.lit(-1))["value"]


def content_parts(prompt: Column, marks=("<image>", "<video>")) -> Column:
    """A prompt as typed parts in order: array<struct<type, text>>, empty text parts dropped."""
    pattern = "(?<=" + "|".join(marks) + ")|(?=" + "|".join(marks) + ")"
    parts = F.split(prompt, pattern, -1)
    kind = lambda p: F.coalesce(*[F.when(p == m, F.lit(m.strip("<>"))) for m in marks], F.lit("text"))
    typed = F.transform(parts, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))
    return F.filter(typed, lambda s: (s["type"] != "text") | (s["text"] != ""))


def mime_type(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext.isin("jpg", "jpeg"), F.lit("image/jpeg")).when(ext.isin("png", "gif", "webp", "bmp"), F.concat(F.lit("image/"), ext)).otherwise(F.lit("application/octet-stream"))


def prompt_row(conversations: Column, images: Column, answer_ids: Column) -> Column:
    """A chat row as a training row: images, problem (last human turn), answer (last model turn, its token and ids)."""
    problem, answer = last_turn(conversations, "human"), last_turn(conversations, "gpt")
    return F.struct(images.alias("images"), problem.alias("problem"), answer.alias("answer_text"), answer_ids.alias("gt"))


def openai_messages(conversations: Column, images: Column) -> Column:
    """ShareGPT turns as messages (role, content, images): all images go with the first user turn that marks one."""
    role = lambda t: F.when(t["from"] == "human", F.lit("user")).when(t["from"] == "gpt", F.lit("assistant")).otherwise(t["from"])
    marked = F.transform(conversations, lambda t: (t["from"] == "human") & F.contains(t["value"], F.lit("<image>")))
    first = F.array_position(marked, F.lit(True))
    none = F.array().cast("array<string>")
    return F.transform(conversations, lambda t, i: F.struct(role(t).alias("role"), t["value"].alias("content"), F.when(i + 1 == first, images).otherwise(none).alias("images")))
