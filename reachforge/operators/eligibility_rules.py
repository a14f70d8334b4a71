"""The rule table of commercial eligibility."""

from __future__ import annotations

from .rules import Rule, Signal

# The term lists decide the results; rule, verdict and reason names are values of output columns.
COMMERCIAL = ("rabatt", "sale", "angebot", "angebote", "coupon", "gutschein", "jetzt kaufen", "online kaufen", "bestellen", "shoppen", "shopping", "shop", "produkt", "produkte", "sortiment", "kollektion", "neu erhältlich", "neu erhaeltlich", "jetzt erhältlich", "jetzt erhaeltlich", "filiale", "store", "öffnungszeiten", "oeffnungszeiten", "eröffnung", "eroeffnung", "lieferung", "versand", "app", "bonus", "punkte", "gewinnspiel", "gewinnen", "einkauf", "einkaufen", "entdecke", "entdecken", "sichere dir", "preis", "aktion")
RECRUITMENT = ("karriere", "karriere bei", "karrierechance", "karrierechancen", "stellenangebot", "stellenangebote", "stellenanzeige", "stellenanzeigen", "offene stelle", "offene stellen", "jobangebot", "jobangebote", "job opening", "job openings", "vacancy", "vacancies", "wir stellen ein", "wir suchen verstärkung", "wir suchen verstaerkung", "verstärke unser team", "verstaerke unser team", "verstärkung für unser team", "verstaerkung fuer unser team", "mitarbeiter gesucht", "mitarbeiterin gesucht", "mitarbeiterinnen gesucht", "werde teil unseres teams", "werde teil des teams", "komm in unser team", "komme in unser team", "join our team", "join the team", "we're hiring", "we are hiring", "now hiring", "ausbildungsplatz", "ausbildungsplätze", "ausbildungsplaetze", "ausbildung bei", "starte deine ausbildung", "duales studium", "werkstudent", "werkstudentin", "praktikumsplatz", "praktikant", "praktikantin", "traineeprogramm", "trainee programm", "graduate programme", "graduate program", "azubi", "auszubildende", "aushilfe gesucht", "minijob")
RECRUITMENT_MARKERS = (r"(?<![a-z0-9])m\s*/\s*w\s*/\s*d(?![a-z0-9])", r"(?<![a-z0-9])w\s*/\s*m\s*/\s*d(?![a-z0-9])", r"(?<![a-z0-9])m\s*/\s*w\s*/\s*x(?![a-z0-9])", r"(?<![a-z0-9])d\s*/\s*m\s*/\s*w(?![a-z0-9])", r"(?<![a-z0-9])m\s*w\s*d(?![a-z0-9])")
APPLICATION = ("bewirb dich", "jetzt bewerben", "bewerbung", "bewerben sie sich", "apply now", "apply today")
EMPLOYMENT = ("job", "jobs", "stelle", "stellen", "karriere", "arbeitgeber", "arbeitsplatz", "mitarbeiter", "mitarbeiterin", "mitarbeitende", "kollege", "kollegin", "kollegen", "team", "ausbildung", "azubi", "praktikum", "praktikant", "werkstudent", "trainee", "duales studium", "vollzeit", "teilzeit", "minijob")
PROGRAMME = ("förderprogramm", "foerderprogramm", "förderprojekt", "foerderprojekt", "bildungsprogramm", "bildungsprojekt", "schulprojekt", "schulprogramm", "kindergartenprojekt", "kindergartenprogramm", "singende kindergärten", "singende kindergaerten", "stipendium", "stipendienprogramm", "förderpreis", "foerderpreis", "projektförderung", "projektfoerderung")
REPORT = ("geschäftsbericht", "geschaeftsbericht", "jahresbericht", "annual report", "unternehmensbericht", "investor relations", "corporate governance", "transparenzbericht", "nachhaltigkeitsbericht", "sustainability report", "menschenrechtsbericht")
INSTITUTIONAL = ("klimaziel", "unternehmensziel", "lieferkette", "geschäftsjahr", "geschaeftsjahr", "vorstand", "geschäftsführung", "geschaeftsfuehrung", "investor", "aktionär", "aktionaer")
SAFETY = ("produktrückruf", "produktrueckruf", "rückrufaktion", "rueckrufaktion", "wichtiger sicherheitshinweis", "sicherheitshinweis", "verbraucherwarnung", "produktwarnung")
LEGAL = ("rechtlicher hinweis", "gesetzlicher hinweis", "pflichtinformation", "pflichtinformationen", "datenschutzhinweis", "datenschutzinformation")
CHARITY = ("wir spenden", "spende", "spenden", "charity", "gemeinnützig", "gemeinnuetzig", "soziales engagement", "gesellschaftliches engagement", "wir unterstützen", "wir unterstuetzen")
SUSTAINABILITY = ("nachhaltigkeit", "nachhaltig", "klimaschutz", "umweltschutz", "recycling", "kreislaufwirtschaft")
SPONSORSHIP = ("wir sind sponsor", "offizieller sponsor", "hauptsponsor", "sponsoring", "offizieller partner")
COMMUNITY = ("community projekt", "community programm", "nachbarschaftsprojekt", "vereinsförderung", "vereinsfoerderung", "initiative")

SIGNALS = {
    "commercial": Signal(COMMERCIAL), "recruitment": Signal(RECRUITMENT), "markers": Signal(RECRUITMENT_MARKERS, regex=True), "application": Signal(APPLICATION),
    "employment": Signal(EMPLOYMENT), "programme": Signal(PROGRAMME), "report": Signal(REPORT), "institutional": Signal(INSTITUTIONAL), "safety": Signal(SAFETY),
    "legal": Signal(LEGAL), "charity": Signal(CHARITY), "sustainability": Signal(SUSTAINABILITY), "sponsorship": Signal(SPONSORSHIP), "community": Signal(COMMUNITY),
}

OUT, REVIEW, KEEP = "exclude_clear_noncommercial", "manual_review", "retain_commercial"
UNCLEAR = "mixed_unclear"

#: In order; the first that fires decides.
RULES = [
    Rule("strong_recruitment_phrase", OUT, "recruitment", ("recruitment",)),
    Rule("explicit_recruitment_gender_marker", OUT, "recruitment", ("markers",)),
    Rule("application_plus_employment_context", OUT, "recruitment", ("application", "employment")),
    Rule("programme_plus_commercial_signal", REVIEW, UNCLEAR, ("programme", "commercial")),
    Rule("clear_noncommercial_programme", OUT, "education_or_participation_programme", ("programme",)),
    Rule("corporate_report_plus_commercial_signal", REVIEW, UNCLEAR, ("report", "commercial")),
    Rule("clear_corporate_report", OUT, "corporate_institutional_reporting", ("report",)),
    Rule("safety_or_recall_signal", REVIEW, UNCLEAR, ("safety",)),
    Rule("legal_notice_plus_commercial_signal", REVIEW, UNCLEAR, ("legal", "commercial")),
    Rule("clear_legal_or_compliance_notice", OUT, "legal_or_compliance_notice", ("legal",)),
    Rule("application_language_without_clear_employment_context", REVIEW, UNCLEAR, ("application",)),
    Rule("csr_or_charity_signal", REVIEW, UNCLEAR, ("charity",)),
    Rule("sustainability_signal", REVIEW, UNCLEAR, ("sustainability",)),
    Rule("sponsorship_signal", REVIEW, UNCLEAR, ("sponsorship",)),
    Rule("community_or_initiative_signal", REVIEW, UNCLEAR, ("community",)),
    Rule("institutional_context_signal", REVIEW, UNCLEAR, ("institutional",)),
]
EMPTY = Rule("no_creative_text_available", REVIEW, UNCLEAR, ())
DEFAULT = Rule("no_high_confidence_noncommercial_rule_triggered", KEEP, "", ())
