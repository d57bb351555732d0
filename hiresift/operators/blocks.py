"""Segmentation of an experience section into blocks of one job each, with or without dates.

Every line gets its signals (title, range of years, year, season, separator before a
company) and those of the line below. They tell where a block begins: at a blank line,
at a title that a second signal confirms, and at a range of years above a title. A
block that is only a date belongs to the one below. Lines stay with their text: all
windows are over the lines of one section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of job titles that open a block.
TITLES = (
    "Stage", "Stagiaire", "DRH", "Responsable", "Charg[éè]e?", "Assistant(?:e)?", "Ing[ée]nieur", "D[ée]veloppeu(?:r|se)", "Consultant", "Manager", "Directeur", "Chef",
    "Analyste", "Coordinateur", "Gestionnaire", "[ÉE]lectricien", "Plombier", "Ma[çc]on", "Menuisier", "M[ée]canicien", "Soudeur", "Infirmi[èe]re?", r"Aide[\-\s]Soignant",
    r"Expert[\-\s]?Comptable", "Comptable", "Auditeur", "Pharmacien", "M[ée]decin", r"Community\s+Manager", r"Digital\s+Marketing", r"Social\s+Media",
    r"(?:Senior|Junior|Lead|Staff)\s+(?:Software\s+|Data\s+)?(?:Engineer|Developer|Analyst|Scientist)", r"Software\s+(?:Engineer|Developer|Architect)",
    r"(?:Front[\s\-]?end|Back[\s\-]?end|Full[\s\-]?Stack)\s+(?:Developer|Engineer)", r"Data\s+(?:Scientist|Analyst|Engineer)", r"Project\s+Manager", r"Product\s+Manager",
    r"Program\s+Manager", r"(?:QA|Test)\s+(?:Engineer|Analyst)", r"(?:DevOps|SRE)\s+Engineer", r"Intern(?:\s+[\-–])?", "Trainee", "Apprentice", "Freelanc(?:e|er)",
)
# What stands before a company, names of seasons, marks of bullets, words that go on until now.
BEFORE_COMPANY = r"\s+(?:chez|at|@|auprès\s+de|au\s+sein\s+de|pour|bei)\s+"
SEASONS = "Summer|Winter|Spring|Fall|Autumn|[ÉE]t[ée]|Printemps|Automne|Hiver"
BULLETS = r"\-•–*→▪►●◆○◯◦"
UNTIL_NOW = r"present|présent|actuel|en\s+cours"

TITLE = r"(?iU)\b(?:" + "|".join(TITLES) + r")\b"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
RANGE = r"(?<!\()\b(?:19|20)[0-9]{2}\s*[-–—]\s*(?:19|20)?[0-9]{2}\b(?!\))"
ONGOING = r"(?iU)\b(?:19|20)[0-9]{2}\s*[-–—]\s*(?:" + UNTIL_NOW + r")\b"
SEASON = r"(?iU)\b(?:Summer|Winter|Spring|Fall|Autumn|[ÉE]t[ée])\s+[0-9]{4}\b"
#: Characters of a title's line with a year, of a block that is a date, and of a block at all.
SHORT_TITLE, SHORT_DATE, SHORTEST = 80, 60, 10


def section_lines(sections: DataFrame, key: str, section: str) -> DataFrame:
    """(key, at, line): trimmed lines, blank ones too; bullets and dashes between jobs begin lines, a season stays with its year."""
    out = F.regexp_replace(F.coalesce(F.col(section), F.lit("")), r"\s+—\s+", "\n")
    out = F.regexp_replace(out, r"\s*[¦•●►○◯◦▸▹‣⁃∙]\s*", "\n")
    out = F.regexp_replace(out, rf"(?iU)\b({SEASONS})\s*\n\s*([0-9]{{4}})\b", "$1 $2")
    return sections.select(key, F.posexplode(F.transform(F.split(out, "\n"), lambda t: F.trim(t))).alias("at", "line"))


def _signals(line: Column) -> dict[str, Column]:
    return {
        "title": F.rlike(line, F.lit(TITLE)), "range": F.rlike(line, F.lit(RANGE)) | F.rlike(line, F.lit(ONGOING)), "year": F.rlike(line, F.lit(YEAR)),
        "season": F.rlike(line, F.lit(SEASON)), "company": F.rlike(line, F.lit("(?i)" + BEFORE_COMPANY)),
    }


def _named(line: Column) -> Column:
    """A line that reads as a company: bullets before a capital, or a capital up to a comma or bracket without year or title."""
    marked = F.rlike(line, F.lit(rf"^(?:[{BULLETS}▸▹‣⁃∙]\s*)+[A-ZÀ-Ö].{{1,80}}$"))
    listed = F.rlike(line, F.lit(r"^[A-ZÀ-Ö].{1,60}?\s*[(,]"))
    return marked | (listed & ~F.rlike(line, F.lit(YEAR)) & ~F.rlike(line, F.lit(TITLE)))


def blocks(lines: DataFrame, key: str = "id") -> DataFrame:
    """(key, block, lines): the blocks of the lines (key, at, line) of a section, numbered from 0, each as its array of lines."""
    order = Window.partitionBy(key).orderBy("at")
    line = F.col("line")
    below = F.coalesce(F.lead("line").over(order), F.lit(""))
    told = lines.withColumn("below", below).withColumns(_signals(line)).withColumns(
        {"below_title": F.rlike("below", F.lit(TITLE)), "below_year": F.rlike("below", F.lit(YEAR)), "below_named": _named(F.col("below"))}
    )
    title_opens = F.col("title") & (F.col("company") | F.col("below_year") | F.col("below_named") | (F.col("year") & (F.char_length("line") < SHORT_TITLE)) | F.col("season"))
    date_opens = (F.col("range") | F.col("season")) & F.col("below_title")
    opens = title_opens | date_opens | F.coalesce(F.lag("line").over(order) == "", F.lit(True))
    cut = told.withColumn("opens", opens).where("line <> ''").withColumn("block", F.sum(F.col("opens").cast("int")).over(order))
    whole = cut.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own"), F.bool_or("title").alias("title"), F.bool_or("year").alias("year"))
    text = F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    marked = whole.withColumn("date", (F.char_length(text) < SHORT_DATE) & ~F.col("title") & F.col("year"))
    # Of consecutive dates every other one takes in the next block, so each block is taken in at most once.
    by_block = Window.partitionBy(key).orderBy("block")
    last_other = F.coalesce(F.last(F.when(~F.col("date"), F.col("block")), ignorenulls=True).over(by_block), F.min("block").over(by_block) - 1)
    odd = F.col("date") & ((F.col("block") - last_other) % 2 == 1)
    joined = marked.withColumn("odd", odd).withColumn("starts", ~F.coalesce(F.lag("odd").over(by_block), F.lit(False)))
    merged = joined.withColumn("group", F.sum(F.col("starts").cast("int")).over(by_block)).groupBy(key, "group").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("own"))
    fine = merged.where(F.char_length(text) > SHORTEST)
    return fine.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("group")) - 1).alias("block"), F.transform("own", lambda x: x["line"]).alias("lines"))


def jobs(found: DataFrame, key: str = "id") -> DataFrame:
    """(key, block, title, dated, missions) of blocks that have a title or a year.

    The title is that of the first of three lines with a title word, without what follows a
    company's separator, dates at its end or a comma, else what stands before such a
    separator in the first line. Missions are bullet lines of ten characters and more.
    """
    cut = lambda t: F.get(F.split(t, r"(?i)\s*(?:--|@|\||\bchez\b|\bat\b|\bau\s+sein\s+de\b)", 2), F.lit(0))
    dated = r"(?i)[\s,(–—\-]*(?:(?:19|20)[0-9]{2}\s*[-–—]\s*)?(?:(?:19|20)[0-9]{2}|" + UNTIL_NOW + r")\)?\s*$"
    plain = lambda t: F.btrim(F.get(F.split(F.regexp_replace(cut(t), dated, ""), ",", 2), F.lit(0)), F.lit(" \t–—-|"))
    short = lambda t: F.when(F.char_length(plain(t)) <= 60, plain(t)).otherwise(F.regexp_extract(plain(t), TITLE, 0))
    titles = F.filter(F.transform(F.slice("lines", 1, 3), lambda t: F.when(F.rlike(plain(t), F.lit(TITLE)), short(t))), lambda t: F.char_length(t) >= 3)
    first = F.get("lines", F.lit(0))
    before = F.btrim(F.get(F.split(first, r"(?i)\bchez\b|\bat\b|@|\bau\s+sein\s+de\b|\bpour\b", 2), F.lit(0)), F.lit(" -–—|"))
    separated = F.when(F.rlike(first, F.lit(r"(?i)\bchez\b|\bat\b|@|\bau\s+sein\s+de\b|\bpour\b")) & (F.char_length(before) >= 3), before)
    bullets = F.filter("lines", lambda t: F.rlike(t, F.lit(f"^[{BULLETS}]")))
    missions = F.filter(F.transform(bullets, lambda t: F.regexp_replace(t, rf"^[{BULLETS}\s]+", "")), lambda t: F.char_length(t) >= 10)
    out = found.select(
        key, "block", F.coalesce(F.get(titles, F.lit(0)), separated).alias("title"), F.exists("lines", lambda t: F.rlike(t, F.lit(YEAR))).alias("dated"), missions.alias("missions")
    )
    return out.where(F.col("title").isNotNull() | F.col("dated"))
