"""Text functions as column expressions: tags, formats, JSON in chatter, prompts, classes by keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the question kinds, and the wording scores.
QUESTION_KINDS = ("multiple choice", "numerical", "regression")
WORDING_SCORES = (("perfect", 9.0), ("excellent", 9.0), ("good", 7.0), ("acceptable", 5.0), ("okay", 5.0))
DEFAULT_WORDING_SCORE = 3.0

_EDGE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, _EDGE, "")


def missing(answer: Column) -> Column:
    """Null, empty or the word None."""
    return answer.isNull() | answer.isin("", "None")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def squeeze_tags(text: Column) -> Column:
    """No white space around ``<``, ``>`` and ``/``."""
    return F.regexp_replace(text, r"(?U)\s*(<|>|/)\s*", "$1")


def solver_format(text: Column) -> Column:
    """1.0 for thoughts followed by a boxed answer and nothing else, else 0.0."""
    return F.when(text.rlike(r"(?sU)^<think>.*</think>\s*\\boxed\{.*\}\s*\z"), 1.0).otherwise(0.0)


def questioner_format(text: Column, kinds: Sequence[str] = QUESTION_KINDS) -> Column:
    """1.0 for a kind, a question and an answer in their tags and nothing else."""
    names = "|".join(kinds)
    return F.when(text.rlike(rf"(?sU)^<type>(?:{names})</type>\s*<question>.*</question>\s*<answer>.*</answer>\s*\z"), 1.0).otherwise(0.0)


def tag_content(text: Column, tag: str) -> Column:
    """What the first such tag holds; null if there is none."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def tag_or_all(text: Column, tag: str) -> Column:
    """What the tag holds, or else the whole text, without white space around it."""
    return strip(F.coalesce(tag_content(text, tag), text))


def question_triple(text: Column, kinds: Sequence[str] = QUESTION_KINDS) -> Column:
    """Kind, question and answer as a struct; null if one is missing."""
    pattern = rf"(?s)<type>({'|'.join(kinds)})</type>\s*<question>(.*?)</question>\s*<answer>(.*?)</answer>"
    part = lambda k: strip(F.regexp_extract(text, pattern, k))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("kind"), part(2).alias("question"), part(3).alias("answer")))


def boxed(text: Column) -> Column:
    """The first boxed content up to a closing brace, stripped; null if there is none."""
    pattern = r"\\boxed\{([^}]*)\}"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def repair_json(text: Column) -> Column:
    """Without commas before a closing brace or bracket."""
    return F.regexp_replace(F.regexp_replace(text, r",(\s*)\}", "$1}"), r",(\s*)\]", "$1]")


def json_in_chatter(text: Column) -> Column:
    """From the first opening brace to the last closing one, repaired; null if there is none."""
    return F.nullif(repair_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)), F.lit(""))


def without_fence(text: Column) -> Column:
    """The inside of a fenced block, or the text itself."""
    pattern = r"(?s)```(?:json)?\s*(.*?)```"
    return strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def json_field(text: Column, path: str, data_type: str, default) -> Column:
    """A field of a JSON text in a type, or the default where it is missing or of another type."""
    return F.coalesce(F.get_json_object(text, path).try_cast(data_type), F.lit(default).cast(data_type))


def has_choices(question: Column) -> Column:
    """An option with text, and at least three options."""
    return question.rlike(r"[A-D]\.\s*.+") & (F.regexp_count(question, F.lit(r"[A-D]\.")) >= 3)


def choice_letter(answer: Column) -> Column:
    """The option's letter: the first of A to D in either case, as a capital; null if none."""
    own = F.upper(F.substring(answer, 1, 1))
    found = F.upper(F.regexp_extract(answer, "([A-Da-d])", 1))
    return F.when(answer.rlike(r"^[A-Da-d]\.?"), own).otherwise(F.nullif(found, F.lit("")))


def question_kind(question: Column) -> Column:
    return F.when(question.contains("\nA.") | question.contains("\nB."), "multiple choice").otherwise("numerical")


def keyword_class(text: Column, keywords: dict[str, Sequence[str]], default: str) -> Column:
    """The class with most keywords in the text, each counted once; of equals the first; the default without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for words in keywords.values()]
    top = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.when(top == 0, default)
    for name, hit in zip(keywords, hits, strict=True):
        out = out.when(hit == top, name)
    return out


def named_class(reply: Column, names: Sequence[str], default: str = "mixed") -> Column:
    """The first word if it is a name, else the first name that occurs, else the default."""
    low = F.lower(strip(reply))
    out = F.when(F.regexp_extract(low, r"^(\S+)", 1).isin(*names), F.regexp_extract(low, r"^(\S+)", 1))
    for name in names:
        out = out.when(low.contains(name), name)
    return out.otherwise(default)


def wording_score(reply: Column) -> Column:
    """A number as it stands; else by the words of praise in it."""
    low = F.lower(reply)
    out = F.when(reply.try_cast("double").isNotNull(), reply.try_cast("double"))
    for word, score in WORDING_SCORES:
        out = out.when(low.contains(word), score)
    return out.otherwise(DEFAULT_WORDING_SCORE)


def image_tag_count(prompt: Column, tag: str = "<image>") -> Column:
    return F.size(F.split(prompt, tag, -1)) - 1


def one_image_tag(prompt: Column) -> Column:
    """Numbered tags become plain; a single one goes to the end, none is added, several leave the prompt as it was."""
    plain = F.regexp_replace(prompt, r"<image\s*\d+>", "<image>")
    n = image_tag_count(plain)
    bare = F.regexp_replace(plain, "<image>", "")
    return F.when(n == 0, F.concat(plain, F.lit("<image>"))).when(n == 1, F.concat(bare, F.lit("<image>"))).otherwise(prompt)


def fill_template(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled by columns, stripped."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), strip(F.coalesce(value, F.lit(""))))
    return out


def row_id(*parts: Column) -> Column:
    """Sixteen hex digits of the md5 of the parts, joined by bars; null counts as empty."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def looks_base64(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/]+={0,2}\z")


def without_data_uri(text: Column) -> Column:
    return F.regexp_replace(text, r"^data:[^,]*;base64,", "")


def from_base64(text: Column) -> Column:
    """The bytes that a text with or without a data URI's head stands for; null if it is none."""
    bare = without_data_uri(text)
    return F.when(looks_base64(bare), F.unbase64(bare))


def three_decimals(number: Column) -> Column:
    """A number as text with three digits behind the point."""
    return F.format_string("%.3f", number.cast("double"))


def is_of_family(model: Column, name: str = "qwen") -> Column:
    """Whether a model's name has the family's in it, in any case."""
    return F.lower(model).contains(name)


def is_scientific(text: Column) -> Column:
    return text.rlike(r"^[+-]?\d+(?:\.\d*)?[eE][+-]?\d+\z")


def gradable(question: Column, answer: Column) -> Column:
    """Not a proof, nothing boxed in the question, no text as the answer."""
    return ~(question.contains("证明") | F.lower(question).contains("box") | F.lower(answer).contains("text"))


def both_negative(a: Column, b: Column) -> Column:
    return F.lower(a).contains("no ") & F.lower(b).contains("no ")
