"""Profiles from CV texts, as joins and windows over their lines.

A text becomes numbered lines, each with the section that the last header above
it opened. Contacts, name, languages, skills, formations and experiences are
then read from lines, and ``parse`` nests them again, one row for each text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.functions import scores, text

from .matching import small, text_terms

# Words that open a section.
SECTIONS = {
    "experience": r"exp[ée]riences?(\s+professionnelles?)?|work\s+experience|professional\s+experience|emplois?|carri[èe]re",
    "formation": r"formations?(\s+acad[ée]miques?)?|[ée]tudes|scolarit[ée]e?|parcours\s+acad[ée]mique|[ée]ducation|dipl[ôo]mes?(\s*&\s*[ée]tudes)?",
    "skills": r"comp[ée]tences?(\s+techniques?)?|skills?|savoir[\s\-]faire|technologies?|outils?|stack\s+technique",
    "languages": r"langues?(\s+parl[ée]es)?|languages?|sprachen|idiomas",
    "contact": r"contacts?|coordonn[ée]es",
    "other": r"projets?|projects?|certifications?|loisirs?|hobbies|int[ée]r[êe]ts|r[ée]f[ée]rences?|publications?|profil|profile|summary|divers",
}
# Diplomas in order, the first that a line names wins: name, years of study after school, spellings without
# accents and punctuation.
DIPLOMAS = (
    ("Doctorat", 8, ("doctorat", "phd", "dphil", "doctorate", "doctoral degree", "these")),
    ("Mastère Spécialisé", 6, ("mastere specialise", "mastere recherche", "mastere professionnel")),
    ("Master 2", 5, ("master 2", "master2", "m2")),
    ("Master 1", 4, ("master 1", "master1", "m1")),
    ("Master", 5, ("master", "masters", "msc")),
    ("Maîtrise", 4, ("maitrise",)),
    ("Diplôme d'Ingénieur", 5, ("diplome d ingenieur", "cycle ingenieur", "cycle d ingenieur", "ingenieur d etat")),
    ("Diplôme National d'Architecture", 5, ("diplome national d architecture",)),
    ("Diplôme d'Ingénieur", 5, ("engineering in", "engineering degree", "degree in engineering")),
    ("MBA", 5, ("mba",)),
    ("Master", 5, ("meng", "mphil", "mres", "march", "llm", "postgraduate diploma", "postgraduate certificate", "postgraduate degree", "pgdip", "pgcert")),
    ("Bac+5", 5, ("bac+5",)),
    ("Licence Professionnelle", 3, ("licence pro", "licence professionnelle")),
    ("Licence", 3, ("licence",)),
    ("Bachelor", 3, ("bachelor", "bachelors", "bsc", "beng", "bba")),
    ("Licence", 3, ("l3", "l2", "l1")),
    ("Bac+3", 3, ("bac+3",)),
    ("DUT", 2, ("dut", "deust", "deug")),
    ("BTS", 2, ("bts",)),
    ("Bac+2", 2, ("bac+2",)),
    ("Cycle Préparatoire", 2, ("prepa", "cpge", "cpi", "classe preparatoire", "classes preparatoires", "cycle preparatoire")),
    ("Licenciatura", 3, ("licenciatura",)),
    ("Bachelor", 3, ("bs", "ba")),
    ("Associate Degree", 2, ("associate degree", "associate s degree", "associate of science", "associate of arts", "aa degree", "aas degree")),
    ("Diploma", 2, ("diploma in", "diploma of", "diplome universitaire", "diplome professionnel")),
    ("Certification", 0, ("certification", "certifications")),
    ("Formation Professionnelle", 0, ("formation professionnelle", "formations professionnelles", "formation qualifiante", "certificat professionnel")),
    ("DEA", 4, ("dea", "diplome d etudes approfondies")),
    ("DESS", 4, ("dess", "diplome d etudes superieures specialisees")),
    ("Diplôme d'État", 3, ("diplome d etat", "d infirmier", "d infirmiere", "de infirmier", "de infirmiere")),
    ("DES (Spécialité médicale)", 6, ("diplome d etudes specialisees",)),
    ("BEP", 1, ("bep", "brevet d etudes professionnelles")),
    ("CAP", 0, ("cap", "certificat d aptitude professionnelle")),
    ("Mention Complémentaire", 0, ("mention complementaire", "mc")),
    ("Baccalauréat", 0, ("baccalaureat", "baccalaureate", "bac")),
    ("High School Diploma", 0, ("a level", "a levels", "high school diploma", "abitur", "аттестат")),
)
# Diplomas that count only as written here, with their years of study and the diploma before which they come.
WRITTEN_DIPLOMAS = (("Diplôme d'Ingénieur", 5, "ingenieur", "MBA"), ("Diplôme d'Ingénieur", 5, "Ingenieur", "MBA"), ("DES (Spécialité médicale)", 6, "DES", "BEP"))
# Spoken languages, and levels by their spellings.
LANGUAGES = {
    "Français": "français|francais|french", "Anglais": "anglais|english", "Arabe": "arabe|arabic", "Espagnol": "espagnol|spanish",
    "Allemand": "allemand|german", "Italien": "italien|italian", "Portugais": "portugais|portuguese", "Chinois": "chinois|chinese",
    "Japonais": "japonais|japanese", "Russe": "russe|russian", "Turc": "turc|turkish",
}
LEVELS = {
    "Langue maternelle": "maternelle|natif|native|mother tongue", "Bilingue": "bilingue|bilingual", "Courant": "courant|fluent|c1|c2",
    "Avancé": "avancé|advanced|b2", "Intermédiaire": "intermédiaire|intermediate|b1", "Débutant": "débutant|notions|basic|beginner|a1|a2",
}


def lines(docs: DataFrame, key: str = "id", raw: str = "raw_text") -> DataFrame:
    """(key, at, line, section): non-empty lines with the section of the last header above; header lines are left out.

    A header that is followed at once by another belongs to a table of contents
    and opens nothing.
    """
    header = lambda pattern: F.lower("line").rlike(r"(?U)^\s*(" + pattern + r")\s*[:\-–]?\s*$")
    name = F.lit(None).cast("string")
    for section, pattern in SECTIONS.items():
        name = F.when(header(pattern), section).otherwise(name)
    # Most lines open no section: one pattern tells.
    name = F.when(header("|".join(SECTIONS.values())), name)
    order = Window.partitionBy(key).orderBy("at")
    listed = (
        docs.select(key, F.posexplode(F.split(text.clean_extracted(F.col(raw)), "\n")).alias("at", "line"))
        .withColumn("line", F.trim("line"))
        .where("line <> ''")
        .withColumn("header", name)
        .withColumn("next_header", F.lead("header").over(order))
    )
    opened = F.when(F.col("header").isNotNull() & F.col("next_header").isNull(), F.col("header"))
    return (
        listed.withColumn("section", F.last(opened, ignorenulls=True).over(order))
        .where("header is null")
        .select(key, "at", "line", "section")
    )


def found_names(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, found): a labelled line, else one of the first ten lines that reads as a name."""
    labelled = F.regexp_extract("line", r"(?iU)^(?:nom(?:\s+complet)?|name|full\s+name)\s*[:\-]\s*(.{3,60})$", 1)
    plain = (F.col("at") < 10) & F.col("line").rlike(r"(?U)^[\p{Lu}][\p{L}'’\-]+(\s+[\p{Lu}][\p{L}'’\-]+){1,3}$")
    job = F.lower("line").rlike(r"(?U)\b(d[ée]veloppeur|developer|ing[ée]nieur|engineer|curriculum|manager|chef|stage|consultant|university|universit[ée])\b")
    found = rows.select(
        key,
        F.when(labelled != "", F.struct(F.lit(0).alias("rank"), "at", F.trim(labelled).alias("name")))
        .when(plain & ~job, F.struct(F.lit(1).alias("rank"), "at", F.col("line").alias("name")))
        .alias("c"),
    ).where("c is not null")
    return found.groupBy(key).agg(F.min("c").alias("c")).select(key, F.col("c.name").alias("found"))


def _name() -> Column:
    """The found name, else one from the address of a profile or the e-mail."""
    slug = F.initcap(F.regexp_replace(F.regexp_extract(F.coalesce("linkedin", F.lit("")), r"/in/([a-z]+-[a-z]+)", 1), "-", " "))
    return F.initcap(F.coalesce("found", F.when(slug != "", slug), text.name_from_email(F.col("email"))))


def names(rows: DataFrame, contacts: DataFrame, key: str = "id") -> DataFrame:
    """Name of each text: found in its lines, else from the address or profile."""
    return contacts.join(found_names(rows, key), key, "left").select(key, _name().alias("name"))


def _contacts(raw: str) -> list[Column]:
    # Without an at sign, written or spelled out, there is no address to repair.
    possible = F.contains(F.col(raw), F.lit("@")) | F.col(raw).rlike(r"(?i)[\(\[]\s*(?:at|arobase)\s*[\)\]]")
    addresses = F.when(possible, text.emails(text.repair_emails(F.col(raw)))).otherwise(F.array().cast("array<string>"))
    return [addresses.alias("emails"), text.phones(F.col(raw)).alias("phones"), text.linkedin(F.col(raw)).alias("linkedin"), text.github(F.col(raw)).alias("github")]


def _firsts(found: DataFrame) -> DataFrame:
    return found.withColumns({"email": F.get("emails", F.lit(0)), "phone": F.get("phones", F.lit(0))})


def contacts(docs: DataFrame, key: str = "id", raw: str = "raw_text") -> DataFrame:
    return _firsts(docs.select(key, *_contacts(raw))).select(key, "email", "phone", "emails", "phones", "linkedin", "github")


def _named(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(table.items()):
        out = F.when(value.rlike(r"(?U)\b(" + pattern + r")\b"), name).otherwise(out)
    return out


def languages(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, language, level): lines of the language section, and elsewhere a language with its level; the first mention wins."""
    low = F.lower("line")
    every = "|".join(LANGUAGES.values())
    stars = F.regexp_extract("line", r"([★*]{1,5})", 1)
    grade = F.regexp_extract("line", r"([1-5])\s*/\s*5", 1)
    of_five = F.when(grade != "", grade.cast("int")).when(stars != "", F.length(stars))
    graded = F.element_at(F.array(*map(F.lit, ("Débutant", "Débutant", "Intermédiaire", "Avancé", "Courant"))), F.coalesce(of_five, F.lit(1)))
    level = F.coalesce(_named(low, LEVELS), F.when(of_five.isNotNull(), graded))
    spoken = rows.where(low.rlike(r"(?U)\b(" + every + r")\b"))
    mentions = (
        spoken.withColumn("level", level)
        .where((F.col("section") == "languages") | F.col("level").isNotNull())
        .select(key, "at", "level", F.explode(F.regexp_extract_all(low, F.lit(r"(?U)\b(" + every + r")\b"), F.lit(1))).alias("word"))
        .withColumn("language", _named(F.col("word"), LANGUAGES))
    )
    order = Window.partitionBy(key, "language").orderBy(F.col("level").isNull(), "at")
    return (
        mentions.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, "at", "language", F.coalesce("level", F.lit("Non spécifié")).alias("level"))
    )


def skills(rows: DataFrame, dictionary: DataFrame, key: str = "id") -> DataFrame:
    """(key, name, category, years, level, source) of dictionary skills in a text; one-letter skills only in the skill section or after "langage".

    The dictionary has (term, name, category), a synonym being a further term of a name.
    """
    placed = lambda kept: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("at", "line")))), lambda x: x["line"]), "\n")
    listed = F.col("section") == "skills"
    whole = rows.groupBy(key).agg(F.lower(placed(F.lit(True))).alias("low"), F.when(F.count_if(listed) > 0, F.lower(placed(listed))).alias("section_body"))
    # Years are looked for, skill by skill, only in a text that names a number of years.
    whole = whole.withColumn("_timed", F.col("low").rlike(r"(?U)\d{1,2}\s*(?:ans?|years?)"))
    ambiguous = F.length("term") <= 2
    # A text's terms are found in its row, so texts meet nothing by a join.
    named = dictionary.select(F.lower("term").alias("term"), "name").distinct()
    found = text_terms(whole, dictionary, "low", "_terms").select(key, "low", "section_body", "_timed", F.inline("_terms"))
    own = found.join(small(named), "term")
    quoted = F.concat(F.lit(r"\Q"), F.col("term"), F.lit(r"\E"))
    alone = F.concat(F.lit(r"(?U)(^|[\s,;:/(])"), quoted, F.lit(r"($|[\s,;/).])"))
    context = F.coalesce(F.regexp_like("section_body", alone), F.lit(False)) | F.regexp_like(
        "low", F.concat(F.lit(r"(?U)(langages?|programmation|language)\s*:?[^\n]{0,40}?\b"), quoted, F.lit(r"($|[\s,;/).])"))
    )
    years = F.coalesce(
        *[
            F.nullif(F.call_function("regexp_extract", F.col("low"), pattern, F.lit(1)), F.lit("")).cast("int")
            for pattern in (
                F.concat(F.lit(r"(?U)(\d{1,2})\s*(?:ans?|years?)\s*(?:d[e'’]?\s*)?(?:exp[ée]rience\s*)?(?:en|de|with|in)?\s*"), quoted),
                F.concat(quoted, F.lit(r"(?U)\s*[\(\[:–\-]\s*(\d{1,2})\s*(?:ans?|years?)")),
                F.concat(quoted, F.lit(r"(?U)\s*,\s*(\d{1,2})\s*(?:ans?|years?)")),
            )
        ]
    )
    kept = own.where(~ambiguous | context).withColumn("years", F.when(F.col("_timed"), years))
    return (
        kept.groupBy(key, "name", "category")
        .agg(F.max("years").alias("years"), F.bool_or(F.coalesce(F.contains("section_body", F.col("term")), F.lit(False))).alias("_s"))
        .select(key, "name", "category", "years", scores.skill_level(F.col("years")).alias("level"), F.when(F.col("_s"), "section").otherwise("texte").alias("source"))
    )


def _first_diploma(value: Column) -> Column:
    """Struct (label, level) of name and years of the first diploma that a line names in whole words."""
    plain = F.replace(text.strip_accents(F.lower(value)), F.lit("."), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s*\+\s*", "+"), r"(?U)[^\w+]+", " ")
    plain, written = F.concat(F.lit(" "), plain, F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(value, r"(?U)[^\w]+", " "), F.lit(" "))

    def first(line: Column) -> Column:
        found = F.lit(None).cast("struct<label:string,level:int>")
        for name, years, spelled in reversed(DIPLOMAS):
            hits = [F.contains(line["plain"], F.lit(f" {s} ")) for s in spelled]
            found = F.when(reduce(or_, hits), F.struct(F.lit(name).alias("label"), F.lit(years).alias("level"))).otherwise(found)
            for own, own_years, as_written, before in WRITTEN_DIPLOMAS:
                if before == name:
                    hit = F.contains(line["written"], F.lit(f" {as_written} "))
                    found = F.when(hit, F.struct(F.lit(own).alias("label"), F.lit(own_years).alias("level"))).otherwise(found)
        return found

    # As a lambda's variable a line's forms are made once, not once a spelling.
    return F.get(F.transform(F.array(F.struct(plain.alias("plain"), written.alias("written"))), first), F.lit(0))


def _diploma(value: Column) -> tuple[Column, Column]:
    found = _first_diploma(value)
    return found["label"], found["level"]


def formations(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, at, diploma, level, school, year, ongoing): diploma lines, with the school and year of the line or the two below.

    The generic Master gives way to Master 1 or 2 of the same school and year.
    """
    low = F.lower("line")
    school = F.regexp_extract("line", r"(?iU)((?:universit[éey]\w*|[ée]cole|institut|faculty|facult[ée]|iut|lyc[ée]e|college|school)\b[^,;|\n]*)", 1)
    year = F.regexp_extract_all("line", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    order = Window.partitionBy(key).orderBy("at")
    marked = rows.where("section = 'formation' or section is null").withColumn("_d", _first_diploma(F.col("line"))).select(
        key, "at", "section", F.col("_d.label").alias("diploma"), F.col("_d.level").alias("level"), F.when(school != "", F.trim(school)).alias("school"),
        F.try_element_at(year, F.lit(-1)).cast("int").alias("year"), low.rlike(r"(?U)\b(en cours|présent|present|current)\b").alias("ongoing"),
    )
    below = [(c, F.lead(c, n).over(order), F.lead("diploma", n).over(order)) for c in ("school", "year") for n in (1, 2)]
    near = marked
    for place, (c, value, other) in enumerate(below):
        near = near.withColumn(f"_{place}", F.when(other.isNull(), value)).withColumn(c, F.col(c))
    near = near.withColumns({"school": F.coalesce("school", "_0", "_1"), "year": F.coalesce("year", "_2", "_3")}).drop("_0", "_1", "_2", "_3")
    found = near.where("diploma is not null and (section = 'formation' or year is not null)")
    fields = ("at", "diploma", "level", "school", "year", "ongoing")
    own = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_f"))
    beside = lambda x, y: x["school"].eqNullSafe(y["school"]) & x["year"].eqNullSafe(y["year"])
    specific = lambda x: F.exists("_f", lambda y: y["diploma"].isin("Master 1", "Master 2") & beside(x, y))
    before = lambda x, i: F.exists(F.slice("_f", F.lit(1), i), lambda y: (x["diploma"] == y["diploma"]) & beside(x, y))
    kept = F.filter("_f", lambda x, i: ~before(x, i) & ((x["diploma"] != "Master") | ~specific(x)))
    return own.select(key, F.inline(kept))


def experiences(rows: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    """(key, at, title, company, start, end, ongoing, months, missions): one for each date range of the experience section.

    A line with a range opens a block that goes on to the line before the next
    one; the first line of text is the title, the second or the rest of the
    title's line the company, and bullet lines are missions.
    """
    span = text.date_range(F.regexp_extract("line", _RANGE, 0))
    order = Window.partitionBy(key).orderBy("at")
    blocks = (
        rows.where("section = 'experience'")
        .withColumn("range", F.when(F.regexp_extract("line", _RANGE, 0) != "", span))
        .withColumn("block", F.sum(F.when(F.col("range.start").isNotNull(), 1).otherwise(0)).over(order))
        .where("block > 0")
    )
    rest = F.trim(F.regexp_replace(F.regexp_replace("line", _RANGE, ""), r"^[\s:|,–\-]+|[\s:|,–\-(]+$", ""))
    bullet = F.col("line").rlike(r"^\s*[•\-*▪–]\s*.{10,}")
    nested = blocks.groupBy(key, "block").agg(
        F.min("at").alias("at"), F.max("range").alias("range"),
        F.sort_array(F.collect_list(F.when(~bullet & (rest != ""), F.struct("at", rest.alias("t"))))).alias("heads"),
        F.sort_array(F.collect_list(F.when(bullet, F.struct("at", F.regexp_replace("line", r"^\s*[•\-*▪–]\s*", "").alias("t"))))).alias("b"),
    )
    head = F.split(F.get("heads", F.lit(0))["t"], r"(?U)\s+(?:chez|at|@|\||–|-)\s+")
    end = F.coalesce(F.col("range.end"), F.when(F.col("range.ongoing"), F.lit(as_of[:7])), F.col("range.start"))
    months = text.months_between(F.col("range.start"), end, F.lit(as_of[:7]))
    return nested.select(
        key, "at", F.get(head, F.lit(0)).alias("title"), F.coalesce(F.get(head, F.lit(1)), F.get("heads", F.lit(1))["t"]).alias("company"),
        F.col("range.start").alias("start"), F.col("range.end").alias("end"), F.col("range.ongoing").alias("ongoing"),
        F.when(F.col("range.end").isNull() & ~F.col("range.ongoing"), 1).otherwise(months).alias("months"), F.col("b.t").alias("missions"),
    )


_MONTH = r"(?:[a-zA-Zéûôà]{3,9}\.?\s+)?"
_RANGE = (
    r"(?iU)(?:(?:depuis|since)\s+" + _MONTH + r"(?:[0-9]{1,2}[/\-])?(?:19|20)[0-9]{2}"
    r"|" + _MONTH + r"(?:[0-9]{1,2}/)?(?:19|20)[0-9]{2}\s*(?:–|—|-|à|au|to)\s*(?:" + _MONTH + r"(?:[0-9]{1,2}/)?(?:19|20)[0-9]{2}|présent|present|aujourd['’]hui|actuel|current|now|en cours))"
)


def parse(docs: DataFrame, dictionary: DataFrame, as_of: str, key: str = "id", raw: str = "raw_text") -> DataFrame:
    """Nested profile of each text, also of one that nothing is found in; texts of under 50 characters carry an error."""
    rows = lines(docs, key, raw)

    def nested(part: DataFrame, name: str, *fields: str) -> DataFrame:
        return part.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    error = F.when(F.char_length(F.coalesce(F.col(raw), F.lit(""))) < 50, "text_too_short").alias("error")
    out = _firsts(docs.select(key, error, text.language_by_keywords(F.col(raw)).alias("cv_language"), *_contacts(raw)))
    out = out.join(found_names(rows, key), key, "left").select(key, "error", "cv_language", "email", "phone", "emails", "phones", "linkedin", "github", _name().alias("name"))
    for part in (
        nested(skills(rows, dictionary, key), "skills", "name", "category", "years", "level", "source"),
        nested(formations(rows, key), "formations", "at", "diploma", "level", "school", "year", "ongoing"),
        nested(experiences(rows, as_of, key), "experiences", "at", "title", "company", "start", "end", "ongoing", "months", "missions"),
        nested(languages(rows, key), "languages", "at", "language", "level"),
    ):
        out = out.join(part, key, "left")
    months = F.aggregate(F.coalesce("experiences", F.array()), F.lit(0), lambda a, e: a + F.coalesce(e["months"], F.lit(0)))
    years = F.floor(months / 12 * 10 + 0.5) / 10
    return out.withColumns(
        {"years": years, "level": F.coalesce(F.array_max(F.transform("formations", lambda f: f["level"])), F.lit(0)), "seniority": scores.seniority(years)}
    )


def layout_text(page_lines: DataFrame, key: str = "page_id", width: str = "page_width") -> DataFrame:
    """Text of pages from positioned lines (key, page_width, x0, y0, x1, text).

    The widest gap between the left edges of narrow lines splits two columns, if
    it is at least 60 and 15 % of the width and both have two lines or more. A
    right column of dates is read together with the left one. A step down of
    over 18 starts a paragraph.
    """
    by_x = Window.partitionBy(key).orderBy("x0", "y0")
    narrow = page_lines.where((F.col("x1") - F.col("x0")) < F.col(width) * 0.65)
    gaps = narrow.withColumn("before", F.lag("x0").over(by_x)).withColumn("gap", F.col("x0") - F.col("before"))
    split = (
        gaps.groupBy(key).agg(F.max(F.struct("gap", ((F.col("x0") + F.col("before")) / 2).alias("at"))).alias("s"), F.max(width).alias("_w"))
        .where(F.col("s.gap") >= F.greatest(F.lit(60.0), F.col("_w") * 0.15)).select(key, F.col("s.at").alias("split"))
    )
    date = r"(?iU)\b((19|20)\d{2}|jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?|oct(ober)?|nov(ember)?|dec(ember)?|janv|f[ée]vr|mars|avr|juin|juil|ao[uû]t|d[eé]c)\b"
    sided = page_lines.join(split, key, "left").withColumn("right", F.coalesce(F.col("x0") >= F.col("split"), F.lit(False)))
    shape = sided.groupBy(key).agg(
        F.count_if("right").alias("n_right"), F.count_if(~F.col("right")).alias("n_left"), F.avg(F.when(F.col("right"), F.length("text"))).alias("mean"),
        F.count_if(F.col("right") & F.col("text").rlike(date)).alias("dates"),
    )
    together = (F.col("n_right") < 2) | (F.col("n_left") < 2) | ((F.col("mean") < 30) & (F.col("dates") / F.col("n_right") >= 0.55))
    placed = sided.join(shape.select(key, together.alias("together")), key).withColumn("col", F.when(F.col("together") | ~F.col("right"), 0).otherwise(1))
    order = Window.partitionBy(key).orderBy("col", "y0", "x0")
    start = (F.lag("col").over(order) != F.col("col")) | ((F.col("y0") - F.lag("y0").over(order)) > 18)
    return (
        placed.withColumn("piece", F.when(F.coalesce(start, F.lit(False)), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
        .groupBy(key)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "y0", "x0", "piece"))), lambda x: x["piece"]), "\n").alias("text"))
    )


def merged_spans(tokens: DataFrame, key: str = "id", most: int = 2) -> DataFrame:
    """Entity spans (key, label, begin, end) from tagged tokens, tokens of one label at most ``most`` apart being one span."""
    order = Window.partitionBy(key).orderBy("begin")
    new = (F.lag("label").over(order) != F.col("label")) | (F.col("begin") - F.lag("end").over(order) > most)
    return (
        tokens.withColumn("span", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order))
        .groupBy(key, "span", "label")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .drop("span")
    )
