"""Column functions on text: normalising, slugs, packed lists, records, fences, frontmatter, retry hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the graph and extraction formats.
SEP = "<SEP>"
FIELD = "<|#|>"
INPUT_HEADING = "---Input Text---"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(col: Column | str) -> Column:
    """Lower case; anything but letters, numbers, underscore and white space becomes a space; runs of white space
    become one; trimmed. Null becomes the empty string. Letters of any script stay."""
    c = F.lower(F.coalesce(_col(col), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def slug(col: Column | str, size: int = 30) -> Column:
    """A name safe for files: lower-case Latin letters and digits joined by hyphens; `entity` if none are left."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(col), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    c = F.when(c == "", "entity").otherwise(c)
    return F.regexp_replace(F.substring(c, 1, size), "^-+|-+$", "")


def document_name(number: Column | str, narrator: Column | str, title: Column | str) -> Column:
    return F.format_string("%04d_%s_%s.md", _col(number), _col(narrator), slug(title))


def clean_markdown(col: Column | str) -> Column:
    """Takes off an outer fence and a leading frontmatter block."""
    c = F.regexp_replace(_col(col), r"\A\s+|\s+\z", "")
    c = F.regexp_replace(c, r"\A```[^\n]*\n", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n?```\s*\z", ""), r"\A\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\A---.*?---", ""), r"\A\s+|\s+\z", "")


def frontmatter(doc_id: Column, narrator: Column, subjects: Column, events: Column, generated_at: Column) -> Column:
    """The block of fields that opens a corpus document."""

    def listed(name: str, ids: Column) -> Column:
        return F.when(F.size(ids) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("  - "), x)), "\n"))).otherwise(f"{name}: []")

    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("doc_id: "), doc_id), F.concat(F.lit("narrator: "), narrator), listed("subject_entity_ids", subjects), listed("source_event_ids", events), F.concat(F.lit("generated_at: '"), generated_at, F.lit("'")), F.lit("---"))


def narrator(col: Column | str, default: str = "unknown") -> Column:
    """The narrator that a document's frontmatter names; the default if there is no block or no such line."""
    block = F.regexp_extract(_col(col), r"(?s)\A---(.*?)(?:---|\z)", 1)
    name = F.regexp_extract(block, r"(?m)^\s*narrator:[ \t]*(.*?)[ \t]*$", 1)
    name = F.regexp_replace(name, "^['\"]+|['\"]+$", "")
    return F.when(name == "", default).otherwise(F.coalesce(name, F.lit(default)))


def narrator_in_head(col: Column | str) -> Column:
    """As above, but from the first 1024 signs alone; null if none."""
    name = F.regexp_extract(F.substring(_col(col), 1, 1024), r"(?m)^narrator:\s*([a-z_]+)", 1)
    return F.when(name != "", name)


def fenced_blocks(col: Column | str) -> Column:
    return F.regexp_extract_all(_col(col), F.lit(r"(?s)```(?:python|py)?\n(.*?)```"), F.lit(1))


def longest_block(col: Column | str) -> Column:
    """The longest fenced block, the first of equals; null if there is none."""
    found = F.transform(fenced_blocks(col), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("block")))
    return F.array_max(found)["block"]


def input_section(col: Column | str) -> Column:
    """The fenced text that follows the input heading of a prompt; empty if there is none."""
    return F.regexp_extract(_col(col), rf"(?s){INPUT_HEADING}\s*```[^\n]*\n(.*?)```", 1)


def is_extraction(prompt: Column | str, asked: Column | None = None) -> Column:
    """Whether a call extracts records: it says so, or its prompt has the input heading."""
    headed = F.contains(F.coalesce(_col(prompt), F.lit("")), F.lit(INPUT_HEADING))
    return headed if asked is None else F.coalesce(asked, F.lit(False)) | headed


def allowed(options: Column | str, keys: list[str]) -> Column:
    """Of a map of options, those that a provider takes."""
    return F.map_filter(_col(options), lambda k, _: k.isin(keys))


#: Words that announce a designation, in the order in which they are tried.
ANNOUNCE = ("алиас", "alias", "позывной", "callsign", "реестровый алиас", "code")


def designations(col: Column | str) -> Column:
    """Designations in a text, in this order: announced ones ("callsign: X-1"), then hyphenated codes in capitals."""
    announced = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(ANNOUNCE)})(?![\p{{L}}\p{{N}}])\s*[:—-]?\s*[*`\"]?([A-Za-z0-9_-]+)"
    codes = r"\b([A-Z0-9]{2,}-[A-Za-z0-9-]+)\b"
    c = F.coalesce(_col(col), F.lit(""))
    return F.concat(F.regexp_extract_all(c, F.lit(announced), F.lit(1)), F.regexp_extract_all(c, F.lit(codes), F.lit(1)))


def fields(col: Column | str) -> Column:
    """The trimmed fields of an extraction line."""
    return F.transform(F.split(_col(col), r"<\|#\|>"), lambda x: F.trim(x))


def lines(col: Column | str) -> Column:
    """Lines of a text, at any Unicode line end; a final line end opens no line."""
    ends = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
    found = F.split(F.coalesce(_col(col), F.lit("")), ends)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def keywords(col: Column | str, least: int = 4) -> Column:
    """Distinct words of so many signs, punctuation kept."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(_col(col), F.lit(""))), r"\s+")), lambda x: F.length(x) >= least)


def unpack(col: Column | str) -> Column:
    """The parts of a packed list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(col), F.lit("")), SEP), lambda x: F.trim(x)), lambda x: x != "")


def merge_packed(*cols: Column | str) -> Column:
    """Packed lists joined, each part once, in the order of first sight."""
    return F.array_join(F.array_distinct(F.concat(*[unpack(c) for c in cols])), SEP)


def basename(col: Column | str) -> Column:
    """What follows the last slash; a backslash is a sign like others."""
    return F.regexp_extract(_col(col), "[^/]*$", 0)


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Two digits, halves to even; `empty` if there is no whole."""
    return F.when(whole > 0, F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, 2)).otherwise(empty)


def retry_delay(message: Column, attempt: Column) -> Column:
    """Seconds to wait: the delay that the message names plus one, else two to the attempt, doubled, at most 60."""
    named = F.regexp_extract(F.coalesce(message, F.lit("")), r"'retryDelay': '(\d+(?:\.\d+)?)s'", 1)
    return F.when(named != "", F.try_to_number(named, F.lit("999999.999")).cast("double") + 1.0).otherwise(F.least(2.0 * F.pow(F.lit(2.0), attempt), F.lit(60.0)))


def retry_wait(code: Column, attempt: Column, tries: int = 5) -> Column:
    """Seconds to wait before the next try, by status code: 2, 4, 8, 16 for too many requests and server errors; null
    where another try is no use (other client errors, or no tries left)."""
    again = (code == 429) | (code >= 500)
    return F.when(again & (attempt < tries - 1), F.pow(F.lit(2.0), attempt + 1))


def utc_iso(time: Column) -> Column:
    """A time in UTC, to the second, with Z. The session's time zone is UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def joined_chunks(chunks: Column, order: Column) -> Column:
    """Aggregate: the parts of a streamed answer, put together in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), chunks.alias("c")))), lambda x: x["c"]), "")


def structural_name(name: Column, *qualifiers: Column) -> Column:
    """A display name that tells homonyms apart: `name (type, owner)`, leaving out what is missing."""
    inside = F.concat_ws(", ", *[F.when(F.trim(q) != "", q) for q in qualifiers])
    return F.when(inside != "", F.concat(name, F.lit(" ("), inside, F.lit(")"))).otherwise(name)
