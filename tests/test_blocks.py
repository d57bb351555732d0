"""Experience sections cut into jobs, with dates and without."""

from hiresift.operators import blocks

SECTIONS = [
    (1, "Développeur chez Acme\n2019 - 2021\n- développement d'un site\nManager, Globex 2015\n• gestion d'une équipe"),
    (2, "2018 - Présent\nData Analyst\nInitech, Lyon\nanalyse de ventes\n\nStagiaire\nHooli (Paris)"),
    (3, "Consultant\n- Umbrella Corp\nrapport mensuel\nConsultant\n- Wayne Corp\nrapport annuel"),
    (4, "2001\n\n2003\n\nComptable en cabinet\nbilans et paie"),
    (5, "texte sans titre ni date, mais assez long"),
    (6, None),
    (7, "Summer\n2016 Intern — Summer 2017 Trainee at Acme"),
]


def cut(spark):
    rows = spark.createDataFrame([(*r, "x") for r in SECTIONS], "id int, section string, block string")
    return blocks.blocks(blocks.section_lines(rows, "id", "section"))


def test_blocks(spark):
    found = {}
    for r in sorted(cut(spark).collect(), key=lambda r: (r.id, r.block)):
        found.setdefault(r.id, []).append(r.lines)
    assert found[1] == [["Développeur chez Acme", "2019 - 2021", "- développement d'un site"], ["Manager, Globex 2015", "gestion d'une équipe"]]
    assert found[2] == [["2018 - Présent", "Data Analyst", "Initech, Lyon", "analyse de ventes"], ["Stagiaire", "Hooli (Paris)"]]
    assert found[3] == [["Consultant", "- Umbrella Corp", "rapport mensuel"], ["Consultant", "- Wayne Corp", "rapport annuel"]]
    # The first date takes in the second, which takes in no more.
    assert found[4] == [["Comptable en cabinet", "bilans et paie"]] or found[4][-1] == ["Comptable en cabinet", "bilans et paie"]
    assert found[5] == [["texte sans titre ni date, mais assez long"]] and 6 not in found
    assert found[7] == [["Summer 2016 Intern"], ["Summer 2017 Trainee at Acme"]]


def test_jobs(spark):
    found = {(r.id, r.block): r for r in blocks.jobs(cut(spark)).collect()}
    assert (found[1, 0].title, found[1, 0].dated, found[1, 0].missions) == ("Développeur", True, ["développement d'un site"])
    assert found[1, 1].title == "Manager" and found[2, 0].title == "Data Analyst" and found[2, 1].title == "Stagiaire" and not found[2, 1].dated
    assert found[3, 1].title == "Consultant" and found[3, 1].missions == ["Wayne Corp"]
    assert found[7, 1].title == "Summer 2017 Trainee" and not any(k[0] in (5, 6) for k in found)
