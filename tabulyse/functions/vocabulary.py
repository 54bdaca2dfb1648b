"""Word lists for synthetic values. Made up for this library; any list may be changed."""

FIRST_NAMES = "Ada Bela Carmen Dario Edda Faris Greta Hiro Imani Jonas Kaya Lior Mira Nils Oana Pavel Quinn Rosa Samir Tove Umar Vera Wim Yara".split()
LAST_NAMES = "Abara Brandt Castell Dvorak Eriksen Fontaine Grau Haddad Ivanov Jansen Kimura Lindqvist Moreau Nakata Okafor Petrov Quiroga Rossi Silva Tanaka Ueda Varga Weber Zhou".split()
WORDS = "amber basin cedar delta ember field grove harbor island jetty kernel lantern meadow north orbit prairie quarry ridge summit timber upland valley willow zephyr".split()
ADJECTIVES = "agile bright compact durable early flexible gentle honest instant modular quiet robust scalable steady tidy vivid".split()
NOUNS = "archive bridge catalog dispatch engine forecast gateway index ledger monitor network outlet planner register schedule toolkit".split()
STATUSES = ["Open", "Paused", "Queued", "Done"]
CATEGORIES = ["Garden", "Kitchen", "Office", "Outdoor", "Travel", "Workshop"]
GENDERS = ["Female", "Male", "Nonbinary"]
CITIES = "Arvik Belmora Corvale Dunmere Eastholm Farrow Glenport Highmoor Ironvale Juniper Kestrel Larkfield Millbrook Northwick Oakhaven Pinecrest".split()
COUNTRIES = "Argentina Brazil Canada Denmark Estonia France Ghana Hungary India Japan Kenya Latvia Mexico Norway Oman Portugal".split()
STATES = "Alder Birch Cobalt Dune Ember Flint Granite Hazel Indigo Jade Kelp Lapis".split()
STREETS = "Acorn Bridge Canal Dock Elm Forge Garden Hill Ivy Lake Market Orchard Park Quay River Station".split()
STREET_KINDS = ["Avenue", "Lane", "Road", "Street"]
COMPANY_ENDINGS = ["Group", "Labs", "Partners", "Works"]
JOBS = "Accountant Analyst Architect Buyer Chemist Curator Designer Editor Engineer Geologist Librarian Nurse Planner Surveyor Teacher Translator".split()
DEPARTMENTS = "Accounts|Analytics|Design|Field Service|Logistics|People|Procurement|Production|Quality|Support".split("|")
COLORS = "Azure Beige Coral Crimson Cyan Gold Indigo Ivory Lavender Lime Maroon Navy Olive Teal Turquoise Violet".split()
#: What a table to try tools with should hold: keys, moments, measures of several spreads, few-valued columns, places on a
#: map, people and how to reach them, and prose. {topic} is the topic's name.
PRESET_COLUMNS = [
    ("{topic}_uid", "UUID"),
    ("measured_at", "Datetime"),
    ("unit_price", "Price"),
    ("weight", "Float"),
    ("in_stock", "Boolean"),
    ("department", "Department"),
    ("latitude", "Latitude"),
    ("longitude", "Longitude"),
    ("delivery_city", "City"),
    ("delivery_country", "Country"),
    ("owner", "Full Name"),
    ("reply_to", "Email"),
    ("hotline", "Phone Number"),
    ("homepage", "URL"),
    ("points", "Integer"),
    ("due", "Date"),
    ("colour", "Color"),
    ("story", "Paragraph"),
    ("year", "Number"),
    ("label", "String"),
    ("grade", "String"),
    ("batch", "Number"),
    ("origin", "String"),
    ("checked", "Date"),
    ("length", "Number"),
]
DOMAINS = ["example.com", "example.net", "example.org"]
