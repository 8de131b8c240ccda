"""The word lists of the analyses, which must equal the reference lists for equal results. See NOTICE."""

GLUE = tuple(
    """
    the a an and or but in on at to for of with by from up about into through during that this these those it
    its is are was were be been being have has had do does did will would should could may might must can
    which who when where why how if than then as so
    """.split()
)

TRANSITION_WORDS = tuple(
    """
    however therefore thus consequently nevertheless moreover furthermore additionally meanwhile instead
    otherwise similarly likewise conversely nonetheless hence accordingly subsequently indeed specifically
    particularly especially
    """.split()
)

TRANSITION_PHRASES = (
    "for example",
    "for instance",
    "in addition",
    "in contrast",
    "on the other hand",
    "as a result",
    "in conclusion",
    "in summary",
    "to summarize",
    "finally",
)

VAGUE_WORDS = tuple(
    """
    thing things stuff nice good bad great terrible amazing awesome interesting very really quite rather
    somewhat pretty fairly
    """.split()
)

VAGUE_PHRASES = (
    "kind of",
    "sort of",
    "a bit",
)

JARGON_WORDS = (
    "synergy",
    "leverage",
    "paradigm",
    "disrupt",
    "innovative",
    "streamline",
    "optimization",
    "scalable",
    "bandwidth",
    "win-win",
    "game changer",
    "best practice",
    "core competency",
    "value-added",
    "going forward",
    "deep dive",
    "reach out",
)

JARGON_PHRASES = (
    "circle back",
    "touch base",
    "low-hanging fruit",
    "move the needle",
    "drink the kool-aid",
    "boil the ocean",
    "think outside the box",
    "at the end of the day",
    "take it offline",
    "drill down",
)

CLICHES = (
    "avoid it like the plague",
    "beat around the bush",
    "better late than never",
    "bite the bullet",
    "break the ice",
    "bring to the table",
    "call it a day",
    "cut to the chase",
    "easy as pie",
    "get the ball rolling",
    "hit the nail on the head",
    "in the nick of time",
    "it goes without saying",
    "jump on the bandwagon",
    "keep your eyes peeled",
    "let the cat out of the bag",
    "piece of cake",
    "raining cats and dogs",
    "the best of both worlds",
    "throw in the towel",
    "time flies",
    "under the weather",
    "when pigs fly",
    "whole nine yards",
    "a blessing in disguise",
    "a dime a dozen",
    "actions speak louder than words",
    "add insult to injury",
    "at the drop of a hat",
    "back to square one",
    "barking up the wrong tree",
    "bent out of shape",
    "bite off more than you can chew",
    "break a leg",
    "burning the midnight oil",
    "caught between a rock and a hard place",
    "costs an arm and a leg",
    "cry over spilled milk",
    "curiosity killed the cat",
    "devil's advocate",
    "don't count your chickens",
    "every cloud has a silver lining",
)

CONJUNCTIONS = tuple(
    """
    and but or so yet for nor
    """.split()
)

ABBREVIATIONS = (
    "mr",
    "mrs",
    "ms",
    "miss",
    "dr",
    "prof",
    "rev",
    "fr",
    "sr",
    "jr",
    "messrs",
    "mmes",
    "msgr",
    "hon",
    "esq",
    "phd",
    "md",
    "dds",
    "capt",
    "col",
    "gen",
    "lt",
    "maj",
    "sgt",
    "cpl",
    "pvt",
    "adm",
    "cmdr",
    "sen",
    "rep",
    "gov",
    "pres",
    "sec",
    "b.a",
    "b.s",
    "m.a",
    "m.s",
    "m.b.a",
    "ph.d",
    "m.d",
    "j.d",
    "ll.b",
    "ll.m",
    "d.d.s",
    "d.v.m",
    "pharm.d",
    "ed.d",
    "psy.d",
    "etc",
    "vs",
    "e.g",
    "i.e",
    "et al",
    "cf",
    "viz",
    "ibid",
    "op. cit",
    "loc. cit",
    "n.b",
    "p.s",
    "r.s.v.p",
    "a.m",
    "p.m",
    "b.c",
    "a.d",
    "c.e",
    "b.c.e",
    "jan",
    "feb",
    "mar",
    "apr",
    "jun",
    "jul",
    "aug",
    "sep",
    "sept",
    "oct",
    "nov",
    "dec",
    "mon",
    "tue",
    "tues",
    "wed",
    "thu",
    "thur",
    "thurs",
    "fri",
    "sat",
    "sun",
    "st",
    "ave",
    "blvd",
    "rd",
    "ct",
    "ln",
    "pl",
    "ter",
    "apt",
    "ste",
    "rm",
    "fl",
    "bldg",
    "dept",
    "u.s",
    "u.k",
    "u.s.a",
    "e.u",
    "n.y",
    "calif",
    "fla",
    "mass",
    "penn",
    "wash",
    "inc",
    "corp",
    "ltd",
    "llc",
    "co",
    "bros",
    "assn",
    "div",
    "mfg",
    "dist",
    "intl",
    "oz",
    "lb",
    "lbs",
    "kg",
    "g",
    "mg",
    "l",
    "ml",
    "cm",
    "mm",
    "m",
    "km",
    "in",
    "ft",
    "yd",
    "mi",
    "sq",
    "cu",
    "mph",
    "kph",
    "rpm",
    "hp",
    "vol",
    "no",
    "nos",
    "p",
    "pp",
    "par",
    "ch",
    "fig",
    "eq",
    "est",
    "approx",
    "min",
    "max",
    "avg",
    "misc",
    "nr",
    "ref",
    "refs",
    "ed",
    "eds",
    "trans",
    "supp",
    "app",
    "encl",
)

IRREGULAR_PARTICIPLES = tuple(
    """
    been done gone seen known given taken made come become written spoken broken chosen driven eaten fallen
    forgotten forgiven frozen gotten hidden ridden risen shaken shown stolen sworn torn thrown worn beaten
    bitten blown drawn flown grown withdrawn begun drunk rung shrunk sunk sprung stunk sung swum spun won hung
    struck stuck swung slung clung flung stung strung wrung arisen awoken borne begotten bidden forbidden
    forsaken hewn lain laden mistaken proven stricken stridden striven thriven trodden waken waxen woven said
    paid laid heard sold told held left kept slept wept swept felt dealt meant sent spent bent lent built
    burnt learnt spelt spoilt dwelt abode awoke bore bound bred brought burst bought cast caught crept dug fed
    fought found fled forbade forecast forgot forsook froze got ground grew hid hit hurt knelt knew led let
    lit lost met overcome overthrown put quit read rid rang ran saw sought set sewed shed shone shot shut
    slain slid slit sown sped split spread stood strewn strode strove taught thought threw thrust took tore
    underwent understood undone upset woken wore wound wove wrought
    """.split()
)

ADJECTIVES = tuple(
    """
    tired excited interested bored confused worried scared frightened amazed surprised shocked pleased
    satisfied disappointed frustrated embarrassed ashamed annoyed delighted thrilled stunned overwhelmed
    talented gifted blessed cursed aged beloved learned skilled experienced advanced supposed alleged
    concerned determined devoted distinguished educated enlightened equipped established esteemed extended
    informed inspired involved limited marked mixed organized packed prepared pronounced qualified refined
    relaxed relieved renowned reserved respected retired sophisticated trained troubled united unmarried used
    varied wasted wicked wounded
    """.split()
)

LINKING_VERBS = tuple(
    """
    seem seems seemed seeming appear appears appeared appearing become becomes became becoming feel feels felt
    feeling look looks looked looking remain remains remained remaining stay stays stayed staying sound sounds
    sounded sounding smell smells smelled smelling taste tastes tasted tasting
    """.split()
)

SUBJECTS = tuple(
    """
    i you he she it we they the a an this that
    """.split()
)

COMMON_VERBS = tuple(
    """
    is are was were be been being have has had do does did will would could should may might must can shall go
    goes went gone make makes made get gets got say says said know knows knew think thinks thought come comes
    came take takes took see sees saw want wants wanted look looks looked use uses used find finds found give
    gives gave tell tells told work works worked call calls called try tries tried ask asks asked need needs
    needed feel feels felt become becomes became leave leaves left put puts run runs ran keep keeps kept let
    lets begin begins began show shows showed hear hears heard play plays played move moves moved live lives
    lived happen happens happened write writes wrote provide provides provided read reads stand stands stood
    """.split()
)

AUXILIARIES = tuple(
    """
    am is are was were be been being get gets got gotten getting
    """.split()
)

#: Sense by sense; a word of several senses counts for the first of them.
SENSES = {
    "sight": tuple(
        """
        see saw seen look looked looking watch watched bright dark light shadow color colorful shiny dull
        vivid brilliant gleaming glowing sparkling shimmering transparent opaque visible invisible
        appearance view glimpse glance stare gaze observe notice spot
        """.split()
    ),
    "sound": tuple(
        """
        hear heard listen listened sound noise loud quiet silent whisper shout scream yell murmur mumble
        echo ring buzz hum bang crash thump click rustle crackle pop snap sizzle hiss roar howl musical
        melodious harmonious deafening piercing
        """.split()
    ),
    "touch": tuple(
        """
        feel felt touch touched soft hard smooth rough texture cold hot warm cool freezing burning icy
        sticky slippery dry wet moist damp sharp dull coarse silky velvety grainy bumpy prickly tender
        firm solid squishy fluffy crisp brittle
        """.split()
    ),
    "smell": tuple(
        """
        smell smelled smelling scent odor aroma fragrance perfume stink stench whiff sniff fragrant
        aromatic pungent acrid musty moldy fresh stale rancid sweet sour spicy floral earthy smoky putrid
        """.split()
    ),
    "taste": tuple(
        """
        taste tasted tasting flavor flavored sweet sour bitter salty savory spicy tangy tart bland mild
        delicious tasty appetizing mouthwatering scrumptious palatable flavorful zesty peppery sugary
        acidic
        """.split()
    ),
}

HIDDEN_VERBS = {
    "decision": "decide",
    "conclusion": "conclude",
    "assumption": "assume",
    "observation": "observe",
    "consideration": "consider",
    "implementation": "implement",
    "investigation": "investigate",
    "examination": "examine",
    "explanation": "explain",
    "discussion": "discuss",
    "analysis": "analyze",
    "recommendation": "recommend",
    "suggestion": "suggest",
    "description": "describe",
}

#: American spelling, British spelling, pattern.
SPELLINGS = (
    ("color", "colour", "OrOur"),
    ("favor", "favour", "OrOur"),
    ("honor", "honour", "OrOur"),
    ("labor", "labour", "OrOur"),
    ("neighbor", "neighbour", "OrOur"),
    ("humor", "humour", "OrOur"),
    ("flavor", "flavour", "OrOur"),
    ("tumor", "tumour", "OrOur"),
    ("vigor", "vigour", "OrOur"),
    ("valor", "valour", "OrOur"),
    ("behavior", "behaviour", "OrOur"),
    ("harbor", "harbour", "OrOur"),
    ("savior", "saviour", "OrOur"),
    ("armor", "armour", "OrOur"),
    ("clamor", "clamour", "OrOur"),
    ("glamor", "glamour", "OrOur"),
    ("parlor", "parlour", "OrOur"),
    ("rancor", "rancour", "OrOur"),
    ("endeavor", "endeavour", "OrOur"),
    ("candor", "candour", "OrOur"),
    ("demeanor", "demeanour", "OrOur"),
    ("splendor", "splendour", "OrOur"),
    ("odor", "odour", "OrOur"),
    ("rumor", "rumour", "OrOur"),
    ("center", "centre", "ErRe"),
    ("meter", "metre", "ErRe"),
    ("fiber", "fibre", "ErRe"),
    ("theater", "theatre", "ErRe"),
    ("somber", "sombre", "ErRe"),
    ("luster", "lustre", "ErRe"),
    ("meager", "meagre", "ErRe"),
    ("caliber", "calibre", "ErRe"),
    ("saber", "sabre", "ErRe"),
    ("specter", "spectre", "ErRe"),
    ("miter", "mitre", "ErRe"),
    ("ocher", "ochre", "ErRe"),
    ("maneuver", "manoeuvre", "ErRe"),
    ("sepulcher", "sepulchre", "ErRe"),
    ("organize", "organise", "IzeIse"),
    ("recognize", "recognise", "IzeIse"),
    ("analyze", "analyse", "IzeIse"),
    ("realize", "realise", "IzeIse"),
    ("customize", "customise", "IzeIse"),
    ("specialize", "specialise", "IzeIse"),
    ("apologize", "apologise", "IzeIse"),
    ("minimize", "minimise", "IzeIse"),
    ("optimize", "optimise", "IzeIse"),
    ("authorize", "authorise", "IzeIse"),
    ("categorize", "categorise", "IzeIse"),
    ("criticize", "criticise", "IzeIse"),
    ("emphasize", "emphasise", "IzeIse"),
    ("finalize", "finalise", "IzeIse"),
    ("initialize", "initialise", "IzeIse"),
    ("standardize", "standardise", "IzeIse"),
    ("summarize", "summarise", "IzeIse"),
    ("utilize", "utilise", "IzeIse"),
    ("defense", "defence", "EnseEnce"),
    ("offense", "offence", "EnseEnce"),
    ("license", "licence", "EnseEnce"),
    ("pretense", "pretence", "EnseEnce"),
    ("analog", "analogue", "OgOgue"),
    ("catalog", "catalogue", "OgOgue"),
    ("dialog", "dialogue", "OgOgue"),
    ("monolog", "monologue", "OgOgue"),
    ("prolog", "prologue", "OgOgue"),
    ("program", "programme", "AmAmme"),
    ("gram", "gramme", "AmAmme"),
    ("traveling", "travelling", "Double"),
    ("canceled", "cancelled", "Double"),
    ("counselor", "counsellor", "Double"),
    ("modeling", "modelling", "Double"),
    ("leveling", "levelling", "Double"),
    ("labeled", "labelled", "Double"),
    ("signaling", "signalling", "Double"),
    ("marvelous", "marvellous", "Double"),
    ("enrollment", "enrolment", "Double"),
    ("fulfillment", "fulfilment", "Double"),
    ("skillful", "skilful", "Double"),
    ("installment", "instalment", "Double"),
    ("gray", "grey", "Misc"),
    ("artifact", "artefact", "Misc"),
    ("skeptic", "sceptic", "Misc"),
    ("jewelry", "jewellery", "Misc"),
    ("aluminum", "aluminium", "Misc"),
    ("pajamas", "pyjamas", "Misc"),
)

HYPHENS = (
    ("email", "e-mail"),
    ("online", "on-line"),
    ("website", "web-site"),
    ("today", "to-day"),
    ("cooperate", "co-operate"),
    ("coordinate", "co-ordinate"),
)

#: Messages on spelling.
SPELLING_MESSAGES = {
    "wrong": 'Wrong dialect: "{bad}" found, expected "{good}" ({dialect})',
    "mixed": 'Mixed US/UK spelling: both "{us}" and "{uk}" found',
    "hyphens": 'Inconsistent hyphenation: both "{a}" and "{b}" found',
}

SUBJECT_VERB = (
    (r"\b(he|she|it)\s+(are|were|have)\b", "Singular subject with plural verb"),
    (r"\b(the\s+\w+)\s+(are|were|have)\b", "Possible singular subject with plural verb"),
    (r"\b(they|we|you)\s+(is|was|has)\b", "Plural subject with singular verb"),
    (r"\b(the\s+\w+s)\s+(is|was|has)\b", "Possible plural subject with singular verb"),
)
#: Messages by kind of issue; those of agreement stand with their patterns.
ISSUES = {
    "DoubleSpace": "Multiple consecutive spaces found",
    "MissingPunctuation": "Sentence missing terminal punctuation",
    "DoubleNegative": "Double negative detected",
    "RunOnSentence": "Possible run-on sentence (multiple conjunction clauses)",
    "CommaSplice": "Possible comma splice",
}
DOUBLE_NEGATIVE = r"\b(don't|doesn't|didn't|won't|can't|couldn't|shouldn't|wouldn't)\s+\w+\s+(no|nothing|nobody|never|nowhere|neither)\b"
RUN_ON = r",\s+(and|but|or|so)\s+\w+\s+\w+\s+,\s+(and|but|or|so)"
BY_PHRASE = r"\bby\s+(?:the\s+)?[a-z]+"
TEMPLATES = {
    "adr": ("Context and Problem Statement", "Decision Drivers", "Considered Options", "Decision Outcome", "Consequences"),
    "handoff": ("Where things stand", "Decisions made", "What's next", "Landmines"),
    "design-doc": ("Overview", "Context", "Approach", "Alternatives considered", "Consequences"),
}
PLACEHOLDERS = ("tbd", "todo", "n/a", "...", "\u2014", "placeholder")
