"""The language profile: constants that other modules take as parameters.

Everything in this file is a fixed value: lists and patterns that results depend on.
"""

#: All white space of Unicode, for character classes of both regular-expression dialects.
WS = " \\t\\r\\f\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

#: The same and the line feed, as characters.
WS_CHARS = "".join(map(chr, (9, 10, 11, 12, 13, *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

PALOCHKA = "ӏ"
#: Consonants after which a look-alike is a palochka, and the same with capitals.
CONSONANTS = "гкхчтпбдзсфвщшцжнмлрй"
CONSONANTS_BOTH = "гкхчщшцжнмлрйбвдзсфтпГКХЧЩШЦЖНМЛРЙБВДЗСФТП"
VOWELS_BOTH = "аеёиоуыьэюяАЕЁИОУЫЬЭЮЯ"

#: What marks a word of the language.
MARKERS = "гӏ|кӏ|хӏ|тӏ|пӏ|цӏ|чӏ|бӏ|дӏ|зӏ|лӏ|нӏ|рӏ|сӏ|фӏ|вӏ|хьа|хьо|хьу|хьи|аьн|еьн|оьн|уьн|ӏал|ӏер|ӏаь|ӏун|гӀ|кӀ|хӀ|тӀ|пӀ|цӀ|чӀ"
TOKEN_MARKERS = "ӏ|гӏ|хь|кх|аь|еь|оь|уь|иь|ийта|аьнна|елла|овла|еннаб"
TOKEN_MARKERS_WIDE = TOKEN_MARKERS + "|юь|яь|ийт|алла|аьб|елаб|илла|ерг|ерш|арг|арш"

#: HTML entities and what they stand for; the order matters.
ENTITIES = (("&mdash;", "—"), ("&ndash;", "–"), ("&nbsp;", " "), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))

#: Endings in the order they are tried; repeated ones are kept.
SUFFIXES = (
    "ашкахьара", "ишкахьара", "ашкахьа", "ишкахьа", "ашкара", "ишкара", "ошкара", "ашта", "ишта", "ошта", "аша", "иша", "оша", "аштса", "иштса", "оштса",
    "ашка", "ишка", "ошка", "ийел", "айел", "ийех", "айех", "ийеха", "айеха", "ашха", "аьш", "нах", "рч", "ари", "аш", "иш", "ий", "ой", "ий", "й",
    "чунгара", "чунга", "чунна", "чунах", "чунца", "чул", "нагара", "нара", "нга", "нна", "нца", "наха", "нал", "нах", "но", "на", "агара", "игара",
    "хьара", "г1ча", "г1а", "ара", "ира", "аца", "ица", "ага", "ига", "ача", "аха", "иха", "хьа", "ана", "ал", "ил", "ах", "га", "ца", "ан", "хь",
    "ийтар", "итар", "ита", "нзар", "цар", "нза", "ург", "аш", "ача", "чу", "чух", "чура", "чул", "ар", "лаг1а", "нне", "лха", "хо", "не", "за", "ра",
    "ло", "л",
)
PREFIXES = ("юха", "хьал", "к1ал", "г1о", "д1а", "т1а", "чу", "хьа", "го")
CLASS_CHANGES = {"в": ("й", "б", "д"), "й": ("в", "б", "д"), "б": ("в", "й", "д"), "д": ("в", "й", "б")}
#: Nominative and oblique stem.
ABLAUT = {"бер": "биер", "дег": "диег", "деш": "диеш", "ден": "диен", "лоам": "лам", "боал": "бал", "тоам": "там"}

MIN_SEGMENT, MAX_SEGMENT, MIN_SCORE = 30, 2000, 0.05
#: Score histogram: lower bound of each bucket.
SCORE_BUCKETS = (0.0, 0.20, 0.25, 0.30, 0.35, 0.40)

#: Grammatical notes instead of a translation.
DERIVED = r"^[\-–\s]*(?:понуд|прич|деепр|масд|кратк|доп|сравн|превосх)[\.\s].*?от\s+([а-яёӏ\-]+)"
BARE = r"^[\-–\s]*(?:понуд|прич|деепр|масд|кратк|доп|сравн|превосх)[\.\s]"

#: (label, from, to): half-open for the time line, closed for the map.
TIMELINE_ERAS = (("imperial", 0, 1917), ("soviet", 1917, 1991), ("modern", 1991, 9999))
MAP_ERAS = ((0, 0, 1859), (1, 1860, 1900), (2, 1901, 1944), (3, 1945, 1991), (4, 1992, 2018), (5, 0, 9999))

VERSES_PER_CHAPTER = (80, 52, 38, 44, 39, 49, 50, 56, 62, 42, 54, 59, 35, 35, 32, 31, 37, 43, 48, 47, 38, 71, 56, 53)
CATEGORY_PRIORITY = {"na-ingushskom": 1, "slovari": 1, "folklor": 1, "loaman-iujre": 1, "detskaya": 2, "poeziya": 2, "hudozhestvennaya": 2, "arhivnye-dokumenty": 3, "sovetskaya-etnografiya": 3, "karty": 3}
TRANSLATE_LANGS, TRANSLATE_MAX = ("inh", "ru"), 2000
BUCKET_CAPACITY, BUCKET_PER_SECOND = 30.0, 0.5
