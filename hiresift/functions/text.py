"""Text clean-up, quality measures and extraction as column expressions.

Patterns carry ``(?U)`` where word characters mean letters of all languages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Words that tell the language of a profile.
FRENCH_SIGNALS = (
    "expérience experience formation compétences competences diplôme diplome entreprise poste missions responsabilités "
    "baccalauréat licence master ingénieur développeur stagiaire alternant langues niveaux courant natif présent actuel "
    "depuis jusqu objet objectif"
).split()
ENGLISH_SIGNALS = (
    "experience education skills objective summary profile position responsibilities achievements projects certifications "
    "bachelor master degree university college internship present current since fluent native proficient worked developed "
    "managed designed implemented"
).split()


def normalise(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space; null as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def normalise_code(text: Column) -> Column:
    """Accent-free lower case with apostrophes and separators as single spaces."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(text, F.lit("")))), r"['’`\-_/,;|\s]+", " "))


def normalise_offer(text: Column) -> Column:
    """Glued words apart at a capital before a small letter, spaces around a slash between words of four letters, single spaces."""
    apart = F.regexp_replace(text, "([a-z])([A-Z][a-z])", "$1 $2")
    slashed = F.regexp_replace(apart, "([a-zA-Z]{4,})/([a-zA-Z]{4,})", "$1 / $2")
    return F.trim(F.regexp_replace(slashed, " {2,}", " "))


def clip_characters(text: Column, most: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def clip_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def clean_extracted(text: Column) -> Column:
    """Extracted page text: one newline kind, no NUL, ligatures spelled, lines trimmed, single blank lines, hyphens joined."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    out = F.replace(F.replace(F.replace(out, F.lit("\u0000"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    out = F.regexp_replace(out, r"[ \t\f\x0B ]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, f"([{LETTERS}])-\n(?=[a-zà-öø-ÿ])", "$1")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def needs_ocr(text: Column, pages: Column, pages_with_text: Column, least: int = 100) -> Column:
    """Why an extracted document needs character recognition; null if it does not."""
    solid = F.regexp_replace(text, r"\s+", "")
    letters = F.char_length(F.regexp_replace(solid, r"(?U)[^\p{L}]", ""))
    return (
        F.when(F.coalesce(pages, F.lit(0)) <= 0, "no_page")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "no_text")
        .when(F.char_length(text) < least, "short")
        .when(pages_with_text == 0, "no_page_with_text")
        .when((pages >= 2) & (pages_with_text / pages < 0.30), "few_pages_with_text")
        .when((F.char_length(solid) < 600) & (letters / F.char_length(solid) < 0.30), "few_letters")
    )


def ocr_quality(text: Column, common: list[str]) -> Column:
    """From 0 to 100: half for the share of letters, then common words, then length up to 500 characters."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    total = F.char_length(clean)
    letters = F.regexp_count(clean, F.lit(f"[{LETTERS}]"))
    own = F.regexp_extract_all(F.lower(clean), F.lit("[a-zà-öø-ÿ]{2,}"), F.lit(0))
    known = F.size(F.filter(own, lambda w: w.isin(common)))
    word_score = F.least(known / F.greatest(F.size(own), F.lit(1)) * 2, F.lit(1.0))
    score = letters / total * 50 + word_score * 30 + F.least(total / 500, F.lit(1.0)) * 20
    return F.when(total == 0, F.lit(0.0)).otherwise(F.floor(score * 10 + 0.5) / 10)


def language_by_keywords(text: Column) -> Column:
    """Struct of language, confidence and hits: French or English by the signal words in the first 2000 characters."""
    own = F.array_distinct(F.split(F.lower(F.substring(text, 1, 2000)), r"\s+"))
    french = F.size(F.array_intersect(own, F.array(*map(F.lit, FRENCH_SIGNALS))))
    english = F.size(F.array_intersect(own, F.array(*map(F.lit, ENGLISH_SIGNALS))))
    share = F.floor(F.greatest(french, english) / (french + english) * 100 + 0.5) / 100
    return F.struct(
        F.when(english > french, "en").otherwise("fr").alias("language"),
        F.when(french == english, F.lit(0.5)).otherwise(share).alias("confidence"),
        french.alias("french"),
        english.alias("english"),
    )


def emails(text: Column) -> Column:
    """Distinct e-mail addresses in lower case, in the order in which they occur."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda e: F.lower(F.rtrim(e, F.lit(".")))))


def repair_emails(text: Column) -> Column:
    """Text with spelled-out and spaced e-mail signs put back."""
    out = F.regexp_replace(text, r"(?i)\s*[\(\[]\s*(?:at|arobase)\s*[\)\]]\s*", "@")
    out = F.regexp_replace(out, r"(?i)\s*[\(\[]\s*(?:dot|point)\s*[\)\]]\s*", ".")
    out = F.regexp_replace(out, r"([a-zA-Z0-9._%+-]+)[ \t]*@[ \t]*([a-zA-Z0-9-]+)", "$1@$2")
    out = F.regexp_replace(out, r"(@[a-zA-Z0-9-]+)[ \t]*\.[ \t]*([a-zA-Z]{2,})", "$1.$2")
    return F.regexp_replace(out, r"(?i)@(gmail|hotmail|yahoo|outlook)[ ]?(com|fr)\b", "@$1.$2")


def phones(text: Column) -> Column:
    """Distinct digit strings of at least 8 digits that read as phone numbers and not as years or identifiers."""
    shape = (
        r"(?:\+|00)\d{1,3}[\s\-.]?(?:\(?\d{1,4}\)?[\s\-.]?){1,4}\d{2,4}"
        r"|\(?\d{2,4}\)?[\s\-.]?\d{2,4}[\s\-.]?\d{2,4}[\s\-.]?\d{2,4}|\d{2}[\s\-.]?\d{3}[\s\-.]?\d{3}"
    )
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shape), F.lit(0))
    digits = F.transform(found, lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.array_distinct(
        F.filter(digits, lambda d: (F.length(d) >= 8) & ~d.rlike("^(19|20)[0-9]{6}$") & ~d.rlike("^0000"))
    )


def linkedin(text: Column) -> Column:
    """Canonical profile address; null without one."""
    name = F.regexp_extract(text, r"(?i)linkedin\.com/in/([a-zA-Z0-9\-_.%]+)", 1)
    bare = F.regexp_extract(
        text, r"(?i)linkedin\.com/(?!in/|company|jobs|feed|learning|school|posts|groups|events)([a-zA-Z0-9\-_.%]+)", 1
    )
    fine = F.coalesce(F.when(name != "", name), F.when(bare != "", bare))
    return F.concat(F.lit("https://linkedin.com/in/"), F.rtrim(fine, F.lit(".")))


def github(text: Column) -> Column:
    name = F.regexp_extract(text, r"(?i)github\.com/(?!features|topics|about|orgs)([a-zA-Z0-9\-_]+)", 1)
    return F.when(name != "", F.concat(F.lit("https://github.com/"), name))


def required_years(text: Column) -> Column:
    """The first number of years that a text asks for."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b([0-9]+(?:[.,][0-9]+)?)\s*(?:\+\s*)?(?:ans|years?)\b", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))


def required_education(text: Column) -> Column:
    """Years of study after school that a text asks for; null if it names none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(low, r"\bbac\s*\+\s*([0-9])\b", 1)
    return (
        F.when(number != "", number.cast("int"))
        .when(low.rlike(r"(?U)\b(master|m\.?sc\.?|dipl[oô]me\s+d['`’]?ing[ée]nieur|ing[ée]nieur)\b"), 5)
        .when(low.rlike(r"(?U)\b(licence|bachelor|b\.?sc\.?|b\.?eng\.?|but|iut)\b"), 3)
        .when(low.rlike(r"(?U)\b(bts|dut|deust)\b"), 2)
    )


def location_score(place: Column, text: Column) -> Column:
    """1 if an offer's place, or a part of it of three letters or more, occurs in a text; 1 without a place."""
    where = F.lower(F.trim(F.coalesce(place, F.lit(""))))
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(where, r"[,/\-|]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    return (
        F.when(where == "", F.lit(1.0))
        .when(low == "", F.lit(0.0))
        .when(F.contains(low, where) | F.exists(parts, lambda p: F.contains(low, p)), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def name_suspicious(name: Column) -> Column:
    """A name that holds digits or signs, or has fewer than two or more than five words."""
    count = F.size(F.split(F.trim(name), r"\s+"))
    return F.coalesce(name.rlike("[0-9@:]") | (count < 2) | (count > 5), F.lit(True))


def name_from_email(email: Column) -> Column:
    """Capitalised words of the part before the at sign, digits left out; null if fewer than two remain."""
    local = F.regexp_replace(F.split_part(email, F.lit("@"), F.lit(1)), "[0-9]+", "")
    parts = F.filter(F.split(local, r"[._\-]+"), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) >= 2, F.initcap(F.array_join(parts, " ")))


def months_between(start: Column, end: Column, as_of: Column) -> Column:
    """Months from one YYYY-MM to another, the last not counted, the end no later than as_of, never under 0."""

    def index(month: Column) -> Column:
        return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")

    return F.greatest(F.lit(0), F.least(index(end), index(as_of)) - index(start))


# Names of months.
MONTHS = {
    1: ("janvier", "janv", "january", "jan",),
    2: ("février", "fevrier", "fév", "fev", "february", "feb",),
    3: ("mars", "march", "mar",),
    4: ("avril", "avr", "april", "apr",),
    5: ("mai", "may",),
    6: ("juin", "june", "jun",),
    7: ("juillet", "juil", "july", "jul",),
    8: ("août", "aout", "august", "aug",),
    9: ("septembre", "sept", "september", "sep",),
    10: ("octobre", "oct", "october",),
    11: ("novembre", "nov", "november",),
    12: ("décembre", "decembre", "déc", "dec", "december",),
}


def date_token(text: Column) -> Column:
    """A month as YYYY-MM from a month name and year, MM/YYYY, YYYY-MM, or a year alone (its January)."""
    low = F.regexp_replace(F.lower(F.trim(text)), r"\.", "")
    word = F.regexp_extract(low, r"(?U)^([a-zà-ÿ]+)\s+((?:19|20)[0-9]{2})$", 1)
    number = F.lit(None).cast("int")
    for month, names in MONTHS.items():
        number = F.when(word.isin(*names), month).otherwise(number)
    year = F.regexp_extract(low, "((?:19|20)[0-9]{2})", 1)
    first = F.regexp_extract(low, r"^([0-9]{1,2})[/\-]((?:19|20)[0-9]{2})$", 1)
    last = F.regexp_extract(low, r"^((?:19|20)[0-9]{2})[/\-]([0-9]{1,2})$", 2)
    month = (
        F.when(word != "", number)
        .when(first != "", first.cast("int"))
        .when(last != "", last.cast("int"))
        .when(low.rlike("^(19|20)[0-9]{2}$"), F.lit(1))
    )
    return F.when((year != "") & month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def date_range(text: Column) -> Column:
    """Struct of start, end and ongoing from a span of two dates or one since a date."""
    ongoing = F.lower(text).rlike(r"(?U)(présent|present|actuel|aujourd|current|now|en cours|depuis|since)")
    bare = F.regexp_replace(F.lower(text), r"(?U)^\s*(depuis|since|de|from)\s+", "")
    parts = F.split(bare, r"(?U)\s*(?:–|—|\s-\s|\bà\b|\bau\b|\bto\b)\s*")
    start, end = date_token(F.get(parts, F.lit(0))), date_token(F.get(parts, F.lit(1)))
    return F.struct(start.alias("start"), F.when(~ongoing, end).alias("end"), ongoing.alias("ongoing"))


def website(text: Column) -> Column:
    """The first web address that is no LinkedIn or GitHub one; null without one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:https?://|www\.)[^\s<>\"]+"), F.lit(0))
    plain = F.transform(found, lambda u: F.rtrim(u, F.lit(".,;)")))
    return F.try_element_at(F.filter(plain, lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com")), F.lit(1))


def address(text: Column, cities: list[str], lines: int = 10) -> Column:
    """What follows an address label, else the first of the first lines that names one of the cities; null without either."""
    body = F.coalesce(text, F.lit(""))
    labelled = F.trim(F.regexp_extract(body, r"(?im)^\s*(?:adresse|address|domicile)\s*[:\-]\s*([^\n]{3,})$", 1))
    named = F.array(*[F.lit(f" {c.lower()} ") for c in cities]) if cities else F.array().cast("array<string>")

    def names_one(line: Column) -> Column:
        plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"(?U)[^\w\-]+", " "), F.lit(" "))
        return F.exists(named, lambda c: F.contains(plain, c))

    head = F.filter(F.slice(F.split(body, "\n"), 1, lines), names_one)
    return F.coalesce(F.when(labelled != "", labelled), F.trim(F.try_element_at(head, F.lit(1))))


def labelled_phones(text: Column) -> Column:
    """Digits of numbers behind a telephone label, at least 8 of them."""
    found = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:t[ée]l(?:[ée]phone)?|phone|mobile|gsm|portable)\s*[.:]*\s*(\+?[0-9][0-9 .()/\-]{6,}[0-9])"), F.lit(1)
    )
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda d: F.length(d) >= 8))


def clean_company(name: Column, stop: list[str]) -> Column:
    """A company's name without brackets, years, months and stop words; empty where only digits are left."""
    months = {m for names in MONTHS.values() for m in names}
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\b(?:[0-9]{1,2}[/\-.])?[0-9]{4}(?:[/\-.][0-9]{1,2})?\b", " ")
    drop = sorted(months | {s.lower() for s in stop})
    words = F.filter(F.split(out, r"\s+"), lambda w: (w != "") & ~F.rtrim(F.lower(w), F.lit(".")).isin(*drop))
    kept = F.btrim(F.array_join(words, " "), F.lit(" ,-;:"))
    return F.when(kept.rlike(r"^[\d\s/\-.]+$"), F.lit("")).otherwise(kept)


def clean_person(name: Column, banned: list[str], most: int = 4) -> Column:
    """A person's name without symbols, addresses and banned words, at most some words long, capitals put right."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}@./:'’\-_]+", " ")
    low = {w.lower() for w in banned}
    fine = lambda w: (w != "") & ~F.contains(w, F.lit("@")) & ~F.lower(w).rlike(r"http|www\.|\.com") & ~F.rtrim(F.lower(w), F.lit(".,;:")).isin(*sorted(low | {""}))
    kept = F.btrim(F.array_join(F.slice(F.filter(F.split(out, r"\s+"), fine), 1, most), " "), F.lit("-: "))
    return F.when(kept == F.upper(kept), F.initcap(kept)).otherwise(kept)
