"""Word lists and tables of the record rules. All are fixed values: results depend on their words and on their order."""

# Month names.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
MONTHS_UK = {
    "січня": 1, "січень": 1, "лютого": 2, "лютий": 2, "березня": 3, "березень": 3, "квітня": 4, "квітень": 4, "травня": 5, "травень": 5, "червня": 6, "червень": 6,
    "липня": 7, "липень": 7, "серпня": 8, "серпень": 8, "вересня": 9, "вересень": 9, "жовтня": 10, "жовтень": 10, "листопада": 11, "листопад": 11, "грудня": 12, "грудень": 12,
}

# Words before a deadline, the first in the list wins, and the length read after them.
DEADLINE_WORDS = [
    "deadline", "дедлайн", "актуально до", "подати до", "подання до", "заповнити до", "заповніть", "приймаються до", "кінцевий термін",
    "термін подання", "не пізніше", "мають бути отримані", "заявки мають бути",
]
DEADLINE_REACH = 220
DEADLINE_TAILS = ["(add to google calendar|google calendar|зафіксувати у google календарі).*", "(share|поділитися|детальніше).*$"]

# Marks of money around a number.
MONEY_MARK = r"(?:€|eur|euro|євро|usd|дол\.?|gbp|£|pounds?|фунт|pln|zloty|злот|cad|c\$|uah|\$|грн|₴)"
MONEY_TEXT_MARK = r"(?:€|eur|euro|євро|грн|uah|₴|usd|дол\.?|c\$|\$|gbp|£|pounds?|фунт|pln|zloty|злот|cad)"
MONEY_TEXT_END = r"(?:€|eur|euro|євро|грн|uah|₴|usd|дол\.?|c\$|\$|gbp|£|pounds?|фунт|pln|zloty|злот|cad|тис\.?|млн\.?)"
MONEY_TEXT_MARKERS = ["€", "eur", "euro", "євро", "грн", "uah", "₴", "usd", "дол", "c$", "$", "gbp", "£", "pound", "фунт", "pln", "zlot", "злот", "cad", "тис", "млн"]
MONEY_SIGNALS = [
    "eur", "euro", "€", "cad", "c$", "canadian dollar", "usd", "$", "gbp", "£", "pound", "pln", "zlot", "uah", "грн", "₴", "євро", "дол", "фунт",
    "funding", "budget", "grant amount", "фінанс", "бюджет", "сума",
]
MONEY_NEAR = r"€|c\$|\$|£|₴|\beur\b|\beuro\b|євро|\busd\b|дол|\bgbp\b|pounds?|фунт|\bpln\b|zloty|злот|\bcad\b|canadian dollar|\buah\b|грн"
MONEY_WORDS = ["funding", "budget", "grant amount", "сума", "фінанс", "бюджет", "підтримк"]
CODE_WORDS = ["квед", "nace", "classification", "класиф"]
CURRENCY_SIGNS = [
    ("EUR", r"€|\b(?:eur|euro)\b|євро"), ("CAD", r"c\$|\bcad\b|canadian dollar"), ("USD", r"\$|\busd\b|дол"), ("GBP", r"£|\bgbp\b|pound|фунт"),
    ("PLN", r"\bpln\b|zlot|злот"), ("UAH", r"₴|грн|\buah\b"),
]
LIMIT_WORDS = ["up to", "до ", "максим", "max"]
AMOUNT_LABELS = "(?:funding|budget|grant amount|сума|бюджет|фінансування)"

# Kinds of support, the first with a word wins, and the opportunity type of each.
SUPPORT_TYPES = [
    ("training", ["training", "тренінг", "тренинг", "курс", "семінар", "workshop"]), ("procurement", ["tender", "procurement", "тендер", "закупів"]),
    ("loan", ["loan", "credit", "кредит"]), ("guarantee", ["guarantee", "гарант"]), ("leasing", ["leasing", "лізинг"]), ("voucher", ["voucher", "ваучер"]),
    ("compensation", ["compensation", "reimbursement", "компенсац", "відшкодуван"]), ("grant", ["grant", "грант", "call for proposals", "конкурс грант"]),
    ("finance_programme", ["finance programme", "finance program", "фінансова програма", "фінансова підтримка"]),
]
OPPORTUNITY_TYPES = {
    "training": "training", "procurement": "tender", "grant": "grant", "loan": "business_support", "guarantee": "business_support", "leasing": "business_support",
    "voucher": "business_support", "compensation": "business_support", "finance_programme": "business_support",
}
OPEN_WORDS = ["open", "active", "ongoing", "forthcoming", "upcoming", "відкрит", "актив", "трива"]
CLOSED_WORDS = ["closed", "expired", "archived", "закрит", "заверш", "архів"]
TRAINING_TITLES = ["тренінг", "тренинг", "training", "workshop", "семінар"]
TRAINING_INTRO = r"(запрошує|реєстрац|набір)[^.]{0,160}(тренінг|тренинг|training|курс|семінар|workshop)"
OFFER_TITLES = ["грант", "конкурс", "запит на подання", "rfa", "request for applications"]
TENDER_TITLES = ["тендер", "tender", "procurement", "закупів"]

# Labels and the words that give them, in lower-case text with a space before and after.
APPLICANT_TYPES = [
    ("SME", ["sme", "small and medium", "small business", "medium business", "мсп", "мсб", "малий бізнес", "середній бізнес"]),
    ("startup", ["startup", "start-up", "стартап", "стартапи", "startups"]),
    ("company", ["company", "companies", "business", "businesses", "підприєм", "бізнес", "компан", "юридичні особи"]),
    ("NGO", ["ngo", "non-profit", "nonprofit", "civil society", "громадськ", "огс", "неприбутков", "благодійн"]),
    ("consortium", ["consortium", "consortia", "консорці", "партнерств", "partners", "eu partners"]),
]
TOPICS = [
    ("AI", [" ai ", "artificial intelligence", "machine learning", "ml ", "llm", "generative ai", "нейромереж", "штучн", "шi", "ші", "машинн"]),
    ("defence", ["defence", "defense", "military", "security and defence", "оборон", "військ", "безпек"]),
    ("dual-use", ["dual-use", "dual use", "подвійн", "подвійного призначення"]),
    ("innovation", ["innovation", "innovative", "r&d", "research and innovation", "інновац", "дослідж", "технолог"]),
    ("community", ["community", "communities", "local community", "local communities", "громад", "місцев", "територіальн"]),
    ("business support", ["business support", "entrepreneurship", "sme", "small business", "підприємниц", "мсп", "мсб"]),
    ("education", ["education", "educational", "training", "course", "освіт", "навчан", "тренінг", "курс"]),
    ("culture", ["culture", "creative", "cultural", "культур", "креатив"]),
    ("humanitarian", ["humanitarian", "human rights", "displaced", "veteran", "relief", "гуманітар", "впо", "ветеран", "постраждал", "захист"]),
]
COUNTRIES = [
    ("Ukraine", ["ukraine", "ukrainian", "україн", "україна", "україни"]), ("EU", ["european union", " eu ", "єс", "європейськ"]), ("Poland", ["poland", "польщ"]),
    ("Germany", ["germany", "німеччин"]), ("Moldova", ["moldova", "молд"]), ("Georgia", ["georgia", "грузі"]), ("Belarus", ["belarus", "білорус"]),
]
REGIONS = [
    ("Vinnytsia", ["вінниць", "vinnytsia"]), ("Volyn", ["волин", "volyn"]), ("Dnipropetrovsk", ["дніпр", "dnipro", "dnipropetrovsk"]), ("Donetsk", ["донець", "donetsk"]),
    ("Zhytomyr", ["житомир", "zhytomyr"]), ("Zakarpattia", ["закарпат", "uzhhorod", "transcarpath"]), ("Zaporizhzhia", ["запоріз", "zaporizh"]),
    ("Ivano-Frankivsk", ["івано-франків", "ivano-frankivsk"]), ("Kyiv", ["київ", "kyiv", "kiev"]), ("Kirovohrad", ["кіровоград", "кропивниць", "kirovohrad", "kropyvnyts"]),
    ("Luhansk", ["лугансь", "luhansk"]), ("Lviv", ["львів", "lviv"]), ("Mykolaiv", ["миколаїв", "mykolaiv"]), ("Odesa", ["одес", "odesa", "odessa"]), ("Poltava", ["полтав", "poltava"]),
    ("Rivne", ["рівнен", "rivne"]), ("Sumy", ["сумсь", "sumy"]), ("Ternopil", ["терноп", "ternopil"]), ("Kharkiv", ["харків", "kharkiv"]), ("Kherson", ["херсон", "kherson"]),
    ("Khmelnytskyi", ["хмельниць", "khmelnyts"]), ("Cherkasy", ["черкас", "cherkasy"]), ("Chernivtsi", ["чернів", "chernivtsi"]), ("Chernihiv", ["черніг", "chernihiv"]),
    ("All Ukraine", ["вся україна", "all ukraine", "nationwide"]),
]
FUNDERS_BY_SOURCE = {"eu-funding": "European Commission", "diia-business": "Diia Business"}
GENERIC_TITLES = ["дія бізнес", "diia business", "вхід", "login", "untitled diia business programme", "untitled opportunity"]
GENERIC_TOPICS = ["grant", "grants", "грант", "гранти", "finance", "financing", "фінанси", "фінансування", "державна підтримка", "підтримка", "business", "бізнес"]
GENERIC_PATHS = ["programs", "finance", "all"]

# Words around which a passage is kept.
ELIGIBILITY_WORDS = ["eligible", "eligibility", "who can apply", "applicants", "для кого", "хто може", "до участі", "заявники", "учасник", "підприєм", "огс"]
RESTRICTION_WORDS = ["not eligible", "not allowed", "restriction", "excluded", "не можуть", "не допуска", "обмеж", "виключ"]
COFINANCING_WORDS = ["cofinancing", "co-financing", "co funding", "co-funding", "співфінанс"]
CONSORTIUM_WORDS = ["consortium", "consortia", "консорці", "партнер"]
GEOGRAPHY_WORDS = ["ukraine", "україн", "єс", "european union", "eu"]

# Names of classes as sources state them.
CLASS_ALIASES = {
    "grant": "grant", "grants": "grant", "business_support": "business_support", "finance_program": "finance_program", "finance_programme": "finance_program",
    "program": "finance_program", "programme": "finance_program", "opportunity": "opportunity", "digest": "digest", "news": "news", "article": "article", "event": "event",
    "webinar": "webinar", "training": "training", "course": "training", "tender": "tender", "procurement": "tender", "unknown": "unknown",
}
NOISE_CLASSES = ["digest", "news", "article", "event", "webinar", "training", "tender"]
# Marks of each class; those of a direct grant in the whole text, all others in the title with a space before and after.
DIRECT_MARKS = [
    "grant", "grants", "грант", "грантов", "call for proposals", "call for applications", "open call", "applications open", "apply now", "cfa", "cfas", "rfp", "rfps",
    "request for proposals", "funding", "fund", "фінанс", "конкурс", "конкурсний", "прийом заяв", "подати заявку", "подання заяв", "відбір заяв", "award", "awards", "prize",
]
DIRECT_TITLE_MARKS = [" grant", " грант", " funding", " фінанс"]
CLASS_MARKS = {
    "digest": [" дайджест ", " добірка ", " digest ", " roundup ", " грантовий гід ", " grant guide ", " opportunities currently open ", " opportunities closing "],
    "webinar": [" вебінар", " webinar", " online seminar", " семінар"],
    "training": [" training", " тренінг", " курс ", " course", " academy", " академі", " навчальн", " bootcamp"],
    "event": [" запрошуємо на ", " захід ", " подія ", " event ", " conference", " конференц", " workshop", " воркшоп", " hackathon", " хакатон", " bootcamp", " табір "],
    "tender": [" tender", " procurement", " тендер", " закупівля послуг", " закупівлі послуг", " постачальник"],
    "news": [" новин", " підсумк", " результати ", " відбулася ", " відбувся ", " долучився ", " долучилась ", " зареєстрував ", " оголосили перемож", " переможц", " тимчасові зміни ", " news ", " update ", " updates "],
    "article": [" як ", " how to ", " guide ", " гайд ", " стаття ", " article ", " поради ", " секрети ", " explains "],
    "finance_program": [" finance program", " finance programme", " фінансова підтримка", " кредит", " компенсац", " відшкодуван", " ваучер", " subsidy", " субсид"],
}
UNCERTAIN_FAMILIES = ["digest_heavy", "aggregator", "empty_or_problem"]
STRUCTURED_FAMILIES = ["structured_direct", "useful_incomplete"]
OFFICIAL_SOURCES = ["eu-funding", "diia-business", "grant-market", "grantforward"]

# Marks of noise in audits, and words of approved records.
NOISE_MARKS = [
    ("possible_digest", ["digest", "дайджест", "добірка", "opportunities currently open", "opportunities closing"]),
    ("possible_news", ["news", "новин", "підсумк", "відбулася", "долучився", "долучилась"]),
    ("possible_article", ["article", "стаття", "як використовувати", "guide", "гайд"]),
    ("possible_webinar", ["webinar", "вебінар"]), ("possible_event", ["event", "подія", "conference", "конференц", "воркшоп", "workshop"]),
]
AUDIT_TRAINING_TITLES = ["тренінг", "training", "course", "курс", "семінар"]
AUDIT_OFFER_TITLES = ["grant", "грант", "конкурс", "call for proposals"]
UNAPPROVED_TITLES = ["grant", "grants", "funding", "opportunity", "opportunities", "грант", "гранти", "конкурс", "можливості"]
UNAPPROVED_TITLE_WORDS = [
    "добірка", "дайджест", "підсумк", "вебінар", "запрошуємо на", "долучився", "долучилась", "відбулася", "воркшоп", "конференц", "презентац", "презентуємо",
    "стратегічна сесія", "оновлено інтерактивний", "як використовувати",
]
APPROVED_TITLE_WORDS = [
    "grant", "grants", "funding", "fund", "call for proposals", "call for applications", "open call", "applications open", "apply now", "cfa", "cfas", "rfp", "rfps",
    "award", "awards", "prize", "programme", "program", "грант", "грантов", "конкурс", "конкурсний", "фінанс", "відшкодуван", "компенсац", "ваучер", "субсид", "кредит",
    "прийом заяв", "подання заяв", "відбір",
]
APPROVED_SUMMARY_WORDS = ["оголошує конкурс", "прийом заяв", "подати заявку", "call for proposals", "call for applications", "applications open"]

# Words of the gates between an opportunity and a client.
NONPROFIT_ONLY = ["non-profit", "nonprofit", "non profit", "неприбутков", "громадські організації", "благодійні фонди", " огс ", "civil society", "charitable foundations"]
COURSE_TITLES = [" набір на ", " табір ", " стипенді", " тренінг", " training", " workshop"]
ACADEMY_TITLES = [" академі", " academy"]
ACADEMY_OFFER_TITLES = ["грант", "grant"]
COURSE_INTRO = ["запрошує на тренінг", "реєстрація на тренінг", "набір учасників"]
RESTRICTION_CHECKS = ["не можуть", "не допуска"]
CLIENT_TYPES = [
    ("ngo", ["ngo", "non-profit", "nonprofit", "громад", "благод"]), ("startup", ["startup", "стартап"]), ("sme", ["sme", "мсп", "мсб", "small", "medium"]),
    ("company", ["company", "business", "підприєм", "компан", "llc", "тов"]),
]
ACCEPTED_TYPES = {"ngo": ["ngo"], "company": ["company", "sme", "startup"], "sme": ["sme", "company", "startup"], "startup": ["startup", "company", "sme"]}

# Query keys that only track a visit.
TRACKING_KEYS = ["fbclid", "gclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "yclid"]
# Currency aliases, the first one contained wins.
CURRENCY_ALIASES = [
    ("EUR", "EUR"), ("EURO", "EUR"), ("ЄВРО", "EUR"), ("€", "EUR"), ("C$", "CAD"), ("CAD", "CAD"), ("CANADIAN DOLLAR", "CAD"),
    ("USD", "USD"), ("US DOLLAR", "USD"), ("DOLLAR", "USD"), ("ДОЛАР", "USD"), ("ДОЛ.", "USD"), ("$", "USD"), ("UAH", "UAH"),
    ("ГРН", "UAH"), ("ГРИВ", "UAH"), ("₴", "UAH"), ("GBP", "GBP"), ("POUND", "GBP"), ("ФУНТ", "GBP"), ("£", "GBP"),
    ("PLN", "PLN"), ("ZLOTY", "PLN"), ("ЗЛОТ", "PLN"),
]
# Words that say nothing about which opportunity a title names.
TITLE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "for", "of", "to", "in", "on", "with", "grant", "grants", "funding", "support", "programme",
    "program", "call", "open", "для", "та", "і", "у", "в", "на", "до", "грант", "гранти", "грантів", "конкурс", "програма", "підтримка",
]

# Sources of each family.
FAMILY_BY_SOURCE = {
    "diia-business": "structured_direct", "eu-funding": "structured_direct", "grantforward": "structured_direct", "chas-zmin": "useful_incomplete", "grant-market": "useful_incomplete",
    "prostir": "useful_incomplete", "nipo": "digest_heavy", "hromady": "digest_heavy", "fundsforngos": "digest_heavy", "opportunitydesk": "digest_heavy",
    "eufundingportal-eu": "aggregator", "gurt": "empty_or_problem",
}
# Two sources of which one lists what the other publishes.
LINKED_SOURCES = ("eu-funding", "eufundingportal-eu")
# Sources whose sums count only near a mark of money.
MARKS_ONLY_SOURCES = ["eu-funding"]

# Columns of landed CSV files.
CLIENT_COLUMNS = ["name", "country", "sector", "organization_type", "technologies", "product_description", "risks", "target_topics", "excluded_topics", "source_documents", "confidence", "extraction_notes"]
HISTORY_COLUMNS = ["client_name", "grant_title", "grant_source", "program_name", "application_date", "result", "country", "applicant_type", "topics", "project_summary", "reusable_materials", "similarity_weight", "notes", "source_documents", "confidence"]

# Names and reasons that results carry.
DIRECT_CLASS, DIRECT_REASON, NOISE_RULE = "grant", "text:direct_grant_signal", "noise_or_non_grant"
TRAINING_NOISE = "possible_training_not_grant"
DUPLICATE_REASON, CLOSED_REASON, NONPROFIT_REASON = "duplicate_grant:", "closed_grant", "nonprofit_only_grant"
STATUS_CHECK, COUNTRY_CHECK, TYPE_CHECK, RESTRICTION_CHECK = "grant status is unknown", "grant countries missing", "grant applicant types missing", "grant restrictions require review"
APPLICATION_TITLE, APPLICATION_SOURCE = "Grant title", "Grant source"
# Words that keep a parenthesis of a title from naming a funder.
NOT_FUNDER_WORDS = ["grant", "грант", "202", "до "]

# Labels of a service's attributes, marks of its kind in order, terms without an end, and locales in order.
SERVICE_LABELS = {
    "term": ["finalProgramTerm", "Кінцевий строк дії програми"], "amount": ["grantAmount", "Сума"], "money": ["currency", "Валюта"],
    "place": ["Область", "Регіон", "Географія"], "eligibility": ["umoviuchasti", "Умови участі"],
}
SERVICE_SUPPORT = [("грант", "grant"), ("кредит", "loan"), ("гарант", "guarantee"), ("лізинг", "leasing"), ("leasing", "leasing"), ("факторинг", "factoring"), ("тендер", "tender_support")]
LASTING_TERMS = ["постій", "безстрок"]
LOCALES = ["ua", "uk", "en"]

# Class names, attributes and prefixes of result cards, and endings of documents.
CARD = {
    "card": "result-item-wrapper", "id": "js-result-id", "link": "grant-url", "summary": "description", "sponsor": "sponsor", "sponsor_path": "/sponsor/detail/",
    "dates": "deadline-tables", "passed": "deadline-passed", "deadline": "deadline-value", "amount": "amount", "title_prefix": "Grant Title:", "amount_prefix": "funding amount:",
}
DOCUMENT_ENDINGS = ["pdf", "doc", "docx", "xls", "xlsx", "zip"]

# What a record is before its text is read again, by source; "" stands for all others.
RECOMPUTED_TYPES = {"diia-business": ("business_support", "finance_programme"), "": ("grant", "grant")}

# Dates and budgets in payloads, and the words of their evidence.
PAYLOAD_DATES = r"\b20\d{2}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
PAYLOAD_DEADLINES = "payload deadline dates: "
BUDGET_KEYS = ["budgetTopicActionMap", "maxContribution"]

# Sources that state amounts and currencies as named attributes, and these names; sources with programmes in their metadata.
ATTRIBUTE_SOURCES = ["diia-business"]
AMOUNT_ATTRIBUTES = ["grantamount", "сума"]
CURRENCY_ATTRIBUTES = ["currency", "валюта"]
PROGRAM_SOURCES = ["eu-funding"]
PROGRAM_KEYS = ["frameworkProgramme", "programme"]

# Words of a programme that has ended or goes on without a deadline, kinds of support that go on, and where they stand.
ENDED_WORDS = ["архів", "прийом заявок завершено", "прийом заявок закрито", "програма завершена", "програма закрита", "неактивна програма"]
LASTING_WORDS = ["постійно", "безстрок", "до припинення", "діє програма", "подати заявку", "отримати грант", "отримати фінансування"]
LASTING_SUPPORT = ["grant", "finance_programme", "loan", "guarantee", "leasing", "factoring"]
LASTING_PAGE = "business.diia.gov.ua/finance"
