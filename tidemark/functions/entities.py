"""Names of entities: what kind they are of, and whether they name anyone at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import name_key

# Kinds that are stored, parts of names that tell systems and public bodies.
KINDS = ("company", "program", "system", "person", "org", "country")
SYSTEMS = ("locust", "smash", "anvil", "roadrunner", "titan", "leonidas", "hivemind")
PUBLIC_BODIES = (
    "air force", "army", "navy", "ministry", "department", "command", "agency", "nato",
    "dod", "government", "govt", "ministry of defense", "ministry of defence",
)
# Names of techniques, by phrase, by the noun they end in, by what they begin with; and words of generic phrases.
TECHNIQUES = (
    r"\b(image captioning|object detection|vehicle detector[s]?|edge detection|feature extraction|semantic segmentation|pose estimation"
    r"|super[- ]resolution|anomaly detection|change detection|target tracking algorithm)\b",
    r"\b[a-zA-Z][\w'-]*(?:[\s-]+[a-zA-Z][\w'-]*){0,4}[\s-]+(?:detection|detector|detectors|segmentation|estimation|extraction|synthesis|translation|recognition"
    r"|tracking|classification|captioning|editing|generation|fusion|calibration|registration)s?\b",
    r"\b(?:GenAI|generative\s+AI|LLM|deep\s+learning|neural\s+network)s?\b[\s:-]+\S",
)
GENERIC = (
    "startup", "developer", "engineer", "weapon", "market", "customer", "supplier",
    "technolog", "behavior", "placement", "architecture", "approach", "capabilit",
    "attack", "answering", "industry", "component", " need", "dataset", "threat",
    "vehicle",
)
GENERIC_HEBREW = (
    "שוק", "תעשיי", "סטארט", "לקוח", "תמונ", "מפעיל", "איומ", "מלחמ", "מצר", "משבר", "משקיע", "תשתי", "אבטח", "ספק", "תצוג", "סביב", "חברות", "תחום", "של מדינה",
)
# Where things are published, and the trade press.
VENUES = ("arxiv", "ieee", "spie", "nature", "reddit", "wikipedia", "youtube", "google scholar")
PRESS = (
    "the war zone", "twz", "breaking defense", "defense news", "defensenews", "jane's", "janes", "jane's defence weekly", "reuters", "associated press",
    "ap news", "c4isrnet", "defense one", "aviation week", "aviationweek", "army technology", "naval technology", "naval news", "military times",
    "the drive", "bloomberg", "the wall street journal", "the new york times", "washington post", "politico", "axios", "cnn", "bbc", "afp",
    "flightglobal", "spacenews", "the diplomat", "unmanned systems technology", "shephard media", "dronexl", "defense update", "israel defense", "dvids",
)


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))


def is_system(name: Column) -> Column:
    return _holds(F.lower(F.coalesce(name, F.lit(""))), SYSTEMS)


def kind_of(name: Column, kind: Column, known: Column) -> Column:
    """The kind that is stored; known is the dictionary's kind of the name, null if it has none.

    Systems are systems, whoever's alias they are; a known name has its dictionary's kind (but programs and systems of that
    name stay so, and a country stays one); public bodies are organisations; other kinds stay if there are such, else org.
    """
    listed = known.isin(*(k for k in KINDS if k != "country"))
    public = _holds(F.lower(F.coalesce(name, F.lit(""))), PUBLIC_BODIES)
    return (
        F.when(is_system(name), "system").when(listed & kind.isin("system", "program"), kind).when(listed, known).when(known == "country", "country")
        .when(public, "org").when(kind.isin(*KINDS), kind).otherwise("org")
    )


def is_technique(name: Column) -> Column:
    """A method's name, or a phrase in lower case about a class of things; null and blank names are none."""
    n = F.trim(F.coalesce(name, F.lit("")))
    phrase = n.rlike(r"^[a-z][\w'-]*(?:\s+\S+)+$") & _holds(F.lower(n), GENERIC)
    return n.rlike("|".join(f"(?i:{p})" for p in TECHNIQUES)) | phrase


def is_generic(name: Column, countries: Column) -> Column:
    """A blank name, a Hebrew phrase about a class of things, or a list of countries (countries: how many of its parts are)."""
    n = F.coalesce(name, F.lit(""))
    return (F.trim(n) == "") | (F.contains(n, F.lit(",")) & (countries >= 2)) | _holds(n, GENERIC_HEBREW)


def is_venue(name: Column) -> Column:
    """Where things are published: such a name, or one that begins with it."""
    key = name_key(name)
    return key.isin(*VENUES) | F.split_part(key, F.lit(" "), F.lit(1)).isin(*VENUES)


def is_junk(name: Column, known: Column, countries: Column) -> Column:
    """Names of no one: techniques and generic phrases unless the dictionary knows them (or they are systems), and venues in any case."""
    real = known.isNotNull() | (is_system(name) & (F.trim(F.coalesce(name, F.lit(""))) != ""))
    return (~real & (is_technique(name) | is_generic(name, countries))) | is_venue(name)


def outlet_key(name: Column) -> Column:
    """A source's own name: lower case, without a last parenthesis or what follows a dash between blanks."""
    bare = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s*\([^)]*\)\s*$", "")
    return F.trim(F.regexp_replace(bare, r"(?s)\s+-\s+.*$", ""))


def is_press(name: Column, source: Column | None = None) -> Column:
    """Trade press: a listed name holds this one or is held by it, or this is (by outlet_key) a polled source's; blank names are none."""
    key = outlet_key(name)
    listed = _holds(key, PRESS) | F.contains(F.lit("\n".join(PRESS)), key)
    return (key != "") & (listed | (F.coalesce(source, F.lit(False)) if source is not None else F.lit(False)))
