"""Word lists and lookup tables that results depend on.

The long list of common words is not stated here: functions that need it take it as a
parameter (`common`), whose default is the stop words.
"""

#: Abbreviations that never end a sentence.
NEVER_END = """mr mrs ms dr prof sr jr st rev hon gen col sgt lt capt cmdr maj pvt supt insp
vs etc eg ie cf viz al et ca circa ibid op cit approx messrs esq fr sra""".split()

#: Abbreviations that end a sentence unless a number, a small letter or a numeral follows.
LABELS = """fig figs sec secs no nos vol vols ch chap pp ed eds inc ltd co corp dept univ assn
bros mt ft ave blvd rd sq pt pts am pm ad bc para paras art ref refs eq eqn app appx temp
spec specs std qty ea hr hrs min mins max avg est wk yr yrs mo mos km cm mm kg lb lbs oz in
hz khz mhz ghz nm ma mv kv rpm psi""".split()

STOPWORDS = """a about above after again against all am an and any are as at be because been
before being below between both but by can cannot could did do does doing down during each
few for from further had has have having he her here hers herself him himself his how i if
in into is it its itself just me more most my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the their
theirs them themselves then there these they this those through to too under until up very
was we were what when where which while who whom why will with would you your yours yourself
yourselves""".split()

FILTER_WORDS = """felt feel feels saw see sees watched watch heard hear hears noticed notice
realised realized realise realize thought think wondered wonder decided knew know remembered
remember seemed seem seems appeared appears looked began begin begins started start starts
tried try tries managed found considered observed sensed experienced""".split()

#: Words in -ly that are no adverbs.
LY_KEEP = """only early family reply supply apply likely lonely holy italy ugly silly daily
weekly monthly yearly friendly lovely assembly""".split()

BE = "am is are was were be been being get gets got gotten".split()

IRREGULAR = """been begun broken brought built bought caught chosen come cut done drawn driven
eaten fallen felt found given gone grown held hidden hit kept known laid led left lost made
meant met paid put read run said seen sent set shown shut sold spoken spent split stood
struck taken taught told thought thrown understood worn won written torn born beaten bound
cast dealt fed fit hurt lit proven rung sung sunk sworn""".split()

NOT_PARTICIPLE = "need indeed embed exceed speed breed seed deed feed bed red shed wed".split()

SUBORDINATORS = """although though because since while whereas unless until when whenever after
before if whether which who whom whose where that as so""".split()

ARTICLES = ["a", "an", "the"]
MODALS = ["shall", "must", "should", "may", "will", "can"]

ACRONYM_SKIP = """OK TV PDF USB USA UK EU AM PM ID TO IT IS AND THE OR NOT IF II III IV VI VII VIII IX XI XII""".split()

INTERIOR = """thought felt knew wondered realised realized remembered hoped feared wanted decided
noticed supposed guessed understood believed considered regretted wished suspected recalled""".split()

SAID = "said says asked asks replied answered told".split()

WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

#: (unit, dimension, factor to the dimension's base unit), matched without regard to case.
UNITS = [
    *[(u, "length", f) for u, f in {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "inch": 0.0254, "inches": 0.0254, "metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0, "thou": 2.54e-5}.items()],
    *[(u, "mass", f) for u, f in {"mg": 1e-6, "g": 0.001, "kg": 1.0, "t": 1000.0, "lb": 0.45359237, "lbs": 0.45359237, "oz": 0.0283495}.items()],
    *[(u, "time", f) for u, f in {"ms": 0.001, "s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "mins": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hr": 3600.0, "hrs": 3600.0, "hour": 3600.0, "hours": 3600.0, "day": 86400.0, "days": 86400.0}.items()],
    *[(u, "torque", f) for u, f in {"nm": 1.0, "n·m": 1.0, "n-m": 1.0, "newton-metre": 1.0, "newton-metres": 1.0, "newton-meter": 1.0, "lbf-ft": 1.35582, "lb-ft": 1.35582, "ft-lb": 1.35582, "ftlb": 1.35582, "lbf-in": 0.112985}.items()],
    *[(u, "pressure", f) for u, f in {"pa": 1.0, "kpa": 1000.0, "mpa": 1e6, "bar": 1e5, "psi": 6894.76, "mbar": 100.0}.items()],
    *[(u, "voltage", f) for u, f in {"mv": 0.001, "v": 1.0, "kv": 1000.0, "volt": 1.0, "volts": 1.0}.items()],
    *[(u, "current", f) for u, f in {"ma": 0.001, "amp": 1.0, "amps": 1.0, "ampere": 1.0, "amperes": 1.0}.items()],
    *[(u, "power", f) for u, f in {"mw": 0.001, "w": 1.0, "kw": 1000.0, "hp": 745.7}.items()],
    *[(u, "frequency", f) for u, f in {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}.items()],
    *[(u, "angle", f) for u, f in {"deg": 1.0, "degree": 1.0, "degrees": 1.0, "°": 1.0, "rad": 57.2958}.items()],
    *[(u, "data", f) for u, f in {"kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "kib": 1024.0, "mib": 1048576.0, "gib": 1073741824.0}.items()],
    *[(u, "resistance", f) for u, f in {"ohm": 1.0, "ohms": 1.0, "kohm": 1e3, "kohms": 1e3}.items()],
    *[(u, "temperature", 1.0) for u in ("°c", "°f", "°k")],
]

#: Units whose case carries meaning; these go before the others.
CASED = [
    ("MPa", "pressure", 1e6), ("mPa", "pressure", 1e-3), ("mV", "voltage", 1e-3), ("MV", "voltage", 1e6),
    ("A", "current", 1.0), ("mA", "current", 1e-3), ("kA", "current", 1e3), ("mW", "power", 1e-3), ("MW", "power", 1e6), ("kW", "power", 1e3),
    ("mHz", "frequency", 1e-3), ("MHz", "frequency", 1e6), ("B", "data", 1.0),
    ("Ω", "resistance", 1.0), ("kΩ", "resistance", 1e3), ("MΩ", "resistance", 1e6), ("mΩ", "resistance", 1e-3),
    ("C", "temperature", 1.0), ("F", "temperature", 1.0), ("K", "temperature", 1.0),
]

QUANTITY_WORDS = """torque pressure voltage current resistance power frequency temperature speed
weight mass length width height depth diameter radius thickness clearance gap tolerance
capacity volume flow duration delay timeout interval range altitude distance load force angle
offset margin rating output input supply drop rise limit setting""".split()

MONTHS = "january february march april may june july august september october november december".split()

MATERIALS = """bronze steel iron wooden wood oak ash copper brass silver gold golden aluminium aluminum tin
lead nickel titanium plastic glass leather stone granite marble ceramic rubber carbon composite
alloy canvas linen silk wool cotton paper clay""".split()
COLOURS = """black white red green blue yellow brown grey gray purple orange pink crimson scarlet amber
auburn blonde blond chestnut hazel violet ivory""".split()
SIZES = """small large big huge tiny enormous vast narrow wide tall short thick thin slender massive
immense compact miniature""".split()
AGES = "old new young ancient elderly modern antique aged brand-new newborn middle-aged venerable".split()
KIN = "brother sister mother father son daughter wife husband cousin uncle aunt partner".split()

CALENDAR = [*WEEKDAYS, *MONTHS, "christmas", "easter", "midsummer", "michaelmas", "lent", "advent"]
#: What stands before a date and not before a person.
DATE_BEFORE = """in on of since until till by last next early late mid every this that each from through
during before after come one a the""".split()

NICKNAMES = {
    "aleksandr": "alexander alex sasha sacha aleksei", "alexander": "aleksandr alex sasha xander", "elizabeth": "eliza liz beth betty libby lisbeth",
    "katherine": "kate katie kathy kitty cat catherine", "margaret": "maggie meg peggy greta rita", "william": "will bill billy liam", "richard": "rick dick richie",
    "robert": "rob bob bobby bert", "james": "jim jimmy jamie", "john": "jack johnny jon", "michael": "mike mick mikey micha", "nicholas": "nick nico niko colin",
    "theodore": "theo ted teddy", "victoria": "vicky vic tori", "dmitri": "dima mitya dmitry", "yekaterina": "katya katerina katia",
}

SECTION_NAMES = [
    "verse", "chorus", "pre-chorus", "prechorus", "post-chorus", "refrain", "bridge", "intro", "outro", "hook", "coda", "interlude", "breakdown", "instrumental", "solo", "tag",
    "drop", "rap", "spoken", "middle eight", "middle 8", "final chorus", "outro chorus", "vamp", "turnaround", "pre chorus", "post chorus", "guitar solo", "fade out", "fade in",
    "build", "build up", "break", "spoken word", "end", "instrumental break", "chant", "choir",
]

#: Voice types and their families; families that may stand for each other.
VOICES = {
    "soprano": "soprano", "mezzo": "mezzo", "mezzo-soprano": "mezzo", "mezzosoprano": "mezzo", "contralto": "contralto", "alto": "contralto", "countertenor": "countertenor", "tenor": "tenor",
    "heldentenor": "tenor", "baritenor": "baritenor", "baritone": "baritone", "bass-baritone": "bass-baritone", "bassbaritone": "bass-baritone", "bass": "bass", "treble": "treble",
}
VOICE_NEIGHBOURS = [("tenor", "baritenor"), ("baritone", "baritenor"), ("baritone", "bass-baritone"), ("bass", "bass-baritone"), ("mezzo", "soprano"), ("mezzo", "contralto")]
#: Words that make a voice type an instrument, after it and before it, and those that keep it a voice.
INSTRUMENT_AFTER = """sax saxes saxophone saxophones drop drops line lines guitar guitars drum drums synth synths clarinet
recorder trombone horn horns flute ukulele boost heavy riff riffs groove pedal pedals player section hits hit wobble
kick note notes""".split()
INSTRUMENT_BEFORE = "808 sub slap synth upright electric double fretless acid deep booming".split()
VOICE_NOUNS = "voice voiced vocal vocals singer register range timbre lead line-up".split()

#: HTML tag names that count as markup.
HTML_TAGS = (
    "a abbr address article aside audio b bdi bdo blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h[1-6] head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p picture pre "
    "q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr u ul var video wbr"
).split()

#: Words that join the words of a title-case term.
CONNECTIVES = ("of", "the", "and", "for", "a", "an", "to", "in", "on")
