"""Rule tables of the resolver: vocabulary, aliases and overrides are data that a caller can replace."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists, aliases and verified identifiers that results depend on.
MOJIBAKE = {
    "â€™": "'",
    "â€˜": "'",
    "â€œ": "\"",
    "â€\x9d": "\"",
    "â€“": "-",
    "â€”": "-",
    "Â": "",
}
TYPOS = {
    "insitute": "institute",
    "institue": "institute",
    "univeristy": "university",
    "unversity": "university",
    "enginering": "engineering",
    "engineeering": "engineering",
    "architechture": "architecture",
    "milia": "millia",
    "rookee": "roorkee",
}
CITY_ALIASES = {
    "bangalore": "bengaluru",
    "bengaluru": "bengaluru",
    "bombay": "mumbai",
    "mumbai": "mumbai",
    "calcutta": "kolkata",
    "kolkata": "kolkata",
    "mysore": "mysuru",
    "mysuru": "mysuru",
    "trivandrum": "thiruvananthapuram",
    "thiruvananthapuram": "thiruvananthapuram",
    "allahabad": "prayagraj",
    "prayagraj": "prayagraj",
    "gurgaon": "gurugram",
    "gurugram": "gurugram",
    "baroda": "vadodara",
    "vadodara": "vadodara",
    "cochin": "kochi",
    "kochi": "kochi",
    "madras": "chennai",
    "chennai": "chennai",
    "new delhi": "new delhi",
    "delhi": "new delhi",
    "greater noida": "greater noida",
    "noida": "noida",
    "bhopal": "bhopal",
    "indore": "indore",
    "jabalpur": "jabalpur",
    "gwalior": "gwalior",
    "sagar": "sagar",
    "ujjain": "ujjain",
    "jaipur": "jaipur",
    "lucknow": "lucknow",
    "pune": "pune",
    "hyderabad": "hyderabad",
    "ahmedabad": "ahmedabad",
    "chandigarh": "chandigarh",
    "dehradun": "dehradun",
    "calicut": "kozhikode",
    "kozhikode": "kozhikode",
    "trichy": "tiruchirappalli",
    "tiruchirapalli": "tiruchirappalli",
    "tiruchirappalli": "tiruchirappalli",
    "panji": "panaji",
    "panaji": "panaji",
    "vadodra": "vadodara",
    "burla": "sambalpur",
    "sambalpur": "sambalpur",
    "shibpur": "shibpur",
    "belgaum": "belagavi",
    "belagavi": "belagavi",
    "vaddeswaram": "guntur",
    "surampalem": "east godavari",
    "peddapuram": "east godavari",
    "yadrav": "kolhapur",
    "ichalkaranji": "kolhapur",
    "tiruchengode": "namakkal",
    "ujire": "mangalore",
    "panvel": "mumbai",
    "navi mumbai": "mumbai",
    "ernakulam": "kochi",
    "narsapur": "hyderabad",
    "medak": "medak",
    "kopargaon": "ahmednagar",
    "ahmed nagar": "ahmednagar",
    "ahmednagar": "ahmednagar",
    "bardoli": "surat",
    "surat": "surat",
    "ottapalam": "palakkad",
    "palakkad": "palakkad",
    "ongole": "prakasam",
    "prakasam": "prakasam",
    "thrikkakara": "kochi",
    "keesara": "hyderabad",
}
PARENT_MARKERS = (
    "faculty", "department", "school", "centre", "center", "academy", "institute",
)
INSTITUTION_WORDS = (
    "university", "institute", "college",
)
GENERIC = (
    "the", "of", "and", "for", "in", "at", "college", "university", "institute", "institution", "institutions", "school", "academy",
    "faculty", "department", "centre", "center", "campus", "medical", "dental", "engineering", "technology", "management", "research",
    "hospital", "arts", "science", "sciences", "studies",
)
ABBREVIATION_STOP = (
    "the", "of", "and", "for", "in", "at",
)
DOMAINS = (
    "medical", "pharmacy", "pharmaceutical", "dental", "ayurvedic", "ayurveda", "homeopathic", "homoeopathic", "nursing", "engineering",
    "technology", "management", "law", "architecture", "polytechnic", "agriculture", "veterinary",
)
IDENTITY_NOISE_MORE = (
    "autonomous", "ugc", "deemed", "private", "formerly", "former", "known", "approved", "affiliated", "education", "foundation", "group",
    "society", "trust", "all", "india", "shri", "sri", "dr", "pvt", "limited", "ltd", "pg", "to", "be", "as",
)
MATCH_NOISE = (
    "autonomous", "ugc", "deemed", "private", "formerly", "former", "known", "approved", "affiliated", "pvt", "limited", "ltd",
)
INTENTS = {
    "architecture": (" architecture ", " b arch ", " barch ",),
    "planning": (" planning ", " b plan ", " bplan ",),
    "engineering": (" engineering ", " b tech ", " btech ", " m tech ", " mtech ",),
    "management": (" management ", " mba ", " pgdm ",),
    "pharmacy": (" pharmacy ", " b pharm ", " bpharm ", " m pharm ", " mpharm ",),
    "law": (" law ", " llb ", " llm ",),
}
VERIFIED = {
    "ln medical college bhopal": 57033,
    "peoples college of dental sciences and research centre bhopal": 58702,
    "mit art design and technology university mitadt": 57115,
    "balaji college of arts commerce and science bcacs": 472,
    "mit arts commerce and science college mitacsc": 59308,
    "iit kharagpur department of architecture and regional planning indian institute of technology kharagpur": 26007,
    "iit roorkee department of architecture and planning indian institute of technology roorkee": 25992,
    "indian institute of technology bhu varanasi department of architecture planning and design varanasi": 25947,
    "iiest shibpur department of architecture and planning shibpur": 28330,
    "cet college of engineering trivandrum department of architecture thiruvananthapuram": 5563,
    "nit calicut national institute of technology department of architecture and planning kozhikode": 25651,
    "nit trichy department of architecture tiruchirapalli": 25889,
    "jamia millia islamia faculty of architecture and ekistics new delhi": 25460,
    "vnit nagpur department of architecture and planning nagpur": 25733,
    "anna university school of architecture and planning chennai": 56307,
    "jadavpur university faculty of architecture kolkata": 26008,
    "maharaja sayajirao university of baroda vadodra": 25500,
    "university of mumbai sir j j college of architecture mumbai": 5680,
    "goa college of architecture panaji": 5586,
    "nit kozhikode national institute of technology faculty of architecture kozhikode": 25651,
    "andhra university department of architecture visakhapatnam": 25346,
    "dr a p j abdul kalam technical university faculty of architecture lucknow": 25941,
    "government engineering college school of architecture and planning thrissur": 13614,
    "bundelkhand university institute of architecture and town planning jhansi": 25927,
    "hemchandracharya north gujarat university institute of architecture patan": 25493,
    "mbm university department of architecture jodhpur": 14122,
    "gautam buddha university department of architecture and regional planning greater noida": 25942,
    "veer surendra sai university of technology department of architecture sambalpur": 25771,
    "mizoram university department of planning and architecture tanhril": 25749,
    "rajiv gandhi government engineering college school of architecture kangra": 60047,
    "sarvajanik university institute of design planning and technology scet idpt scet surat": 14954,
    "amu zakir hussain college of engineering and technology department of architecture aligarh": 5696,
    "netaji subhas university of technology department of architecture and planning new delhi": 14479,
    "indira gandhi delhi technical university for women department of architecture delhi": 13801,
    "rajiv gandhi proudyogiki vishwavidyalaya school of architecture bhopal": 25681,
    "new delhi institute of management ndim": 57120,
    "faculty of engineering and technology jadavpur university kolkata": 26008,
    "vignans foundation for science technology and research guntur": 25384,
    "dr vishwanath karad mit world peace university pune": 18416,
    "east point college of engineering and technology bengaluru": 13428,
    "koneru lakshmaiah education foundation deemed to be university vaddeswaram": 25362,
    "all india shri shivaji memorial societys college of engineering pune": 12779,
    "all india shri shivaji memorial societys institute of information technology pune": 12780,
    "padmasri dr b v raju institute of technology bvrit narsapur": 24327,
    "sanjivani college of engineering kopargaon": 14923,
    "jawaharlal college of engineering and technology palakkad": 45712,
    "faculty of architecture and ekistics jamia millia islamia new delhi": 25460,
    "faculty of architecture and planning aktu lucknow": 25941,
    "integral university faculty of engineering lucknow": 25950,
    "faculty of architecture and planning integral university lucknow": 25950,
    "sharad institute of technology college of engineering yadrav ichalkaranji yadrav ichalkaranji": 15021,
    "the oxford college of architecture bengaluru": 61956,
    "sacred heart college autonomous kochi": 55578,
    "mehr chand mahajan dav college for women chandigarh": 2976,
    "chandigarh engineering college cgc landran mohali mohali": 13197,
    "mlr institute of technology hyderabad": 58194,
    "dr d y patil college of engineering and innovation pune": 58797,
    "jlu school of engineering and technology bhopal": 58674,
    "rise krishan sai prakasam group of institutions ongole": 62801,
    "sri dharmasthala manjunatheshwara college autonomous ujire": 56575,
    "govt model engineering college kochi": 14344,
    "geethanjali college of engineering and technology hyderabad": 13548,
    "annamacharya institute of technology and science tirupati": 28390,
    "rajarajeswari college of engineering bengaluru": 56090,
    "department of architecture and planning iit roorkee roorkee": 25992,
    "dav college jalandhar": 894,
    "amity university noida": 54797,
    "amity university gurgaon": 25516,
    "amity university jaipur": 25797,
    "amity university lucknow": 25920,
    "amity university raipur": 55898,
    "amity university gwalior": 25658,
    "nit patna national institute of technology department of architecture patna": 25417,
}
VERIFIED_REVIEW = {
    "roorkee college of engineering roorkee haridwar university roorkee": 55109,
    "social communications media department scm sophia mumbai": 4639,
}
VERIFIED_ABSENT = (
    "lnct medical college and sewakunj hospital indore", "school of architecture soar j jammu",
    "school of engineering and technology mohali mohali", "school of architecture world school of planning and architecture sonepat",
    "isbm college of engineering pune pune",
)
#: (master_id, name, city, state, short_form, category)
SUPPLEMENT = (
    (60047, "Rajiv Gandhi Govt Engineering College - [RGGEC]", "Kangra", "Himachal Pradesh", "RGGEC Kangra", "Government"),
)
SYSTEM_PHRASES = {
    "indian institute of technology": "iit",
    "national institute of technology": "nit",
    "indian institute of information technology": "iiit",
    "indian institute of management": "iim",
    "birla institute of technology and science": "bits",
}
SYSTEM_SUBUNITS = (
    "department", "faculty", "school", "centre", "center", "management", "design", "entrepreneurship", "online", "distance", "executive",
    "digital", "wilp",
)
DELIVERY = (
    "online", "distance", "executive", "digital",
)
IDENTITY_MARKERS = (
    "university", "institute", "college", "school", "faculty", "department", "technology", "engineering", "iit", "nit", "iiit", "bits",
    "spa",
)
SYSTEM_ACRONYMS = ("iit", "nit", "iiit", "iim", "aiims", "bits")
#: A domain word's group; other domain words stand for themselves.
DOMAIN_GROUPS = {
    "engineering": "engineering_technology", "technology": "engineering_technology", "polytechnic": "engineering_technology",
    "pharmacy": "pharmacy", "pharmaceutical": "pharmacy", "ayurvedic": "ayurveda", "ayurveda": "ayurveda",
    "homeopathic": "homeopathy", "homoeopathic": "homeopathy",
}
#: family: (phrase in name and short form, phrase that excludes it)
FAMILIES = {
    "iiit": ("indian institute of information technology", ""),
    "iit": ("indian institute of technology", "indian institute of information technology"),
    "nit": ("national institute of technology", ""),
    "iim": ("indian institute of management", ""),
    "aiims": ("all india institute of medical sciences", ""),
    "bits": ("birla institute of technology and science", ""),
}
#: suffix: (words that must all occur, the word before which the promoter's name ends); the first that applies is used
UNIT_SUFFIXES = (("coe", ("college", "engineering"), "college"), ("iit", ("institute", "information", "technology"), "institute"), ("cop", ("college", "pharmacy"), "college"))
SUBUNITS = ("department", "faculty", "school")
#: Words ignored in acronyms of inputs, beside ABBREVIATION_STOP.
INPUT_ACRONYM_STOP = ("autonomous", "ugc", "deemed", "formerly", "known", "as")
#: (word of the input, start of the parent's name, words the parent's name must lack, category of the parent)
BRANDS = (("amity", "amity university", ("school", "department", "faculty", "college"), "university"),)


@dataclass(frozen=True)
class RuleSet:
    """All vocabulary the resolver uses; an empty table switches its rule off. `strict` keeps ranked candidates from being accepted unseen;
    `longest_location` prefers the longer of overlapping location phrases to the one that starts last."""

    aliases: dict = field(default_factory=lambda: dict(CITY_ALIASES))
    parent_markers: tuple = PARENT_MARKERS
    institution_words: tuple = INSTITUTION_WORDS
    generic: tuple = GENERIC
    abbreviation_stop: tuple = ABBREVIATION_STOP
    input_acronym_stop: tuple = INPUT_ACRONYM_STOP
    domains: tuple = DOMAINS
    domain_groups: dict = field(default_factory=lambda: dict(DOMAIN_GROUPS))
    identity_noise: tuple = GENERIC + DOMAINS + IDENTITY_NOISE_MORE
    match_noise: tuple = MATCH_NOISE
    typos: dict = field(default_factory=lambda: dict(TYPOS))
    intents: dict = field(default_factory=lambda: dict(INTENTS))
    verified: dict = field(default_factory=lambda: dict(VERIFIED))
    verified_review: dict = field(default_factory=lambda: dict(VERIFIED_REVIEW))
    verified_absent: tuple = tuple(VERIFIED_ABSENT)
    supplement: tuple = tuple(SUPPLEMENT)
    system_acronyms: tuple = SYSTEM_ACRONYMS
    system_phrases: dict = field(default_factory=lambda: dict(SYSTEM_PHRASES))
    system_subunits: tuple = SYSTEM_SUBUNITS
    families: dict = field(default_factory=lambda: dict(FAMILIES))
    delivery: tuple = DELIVERY
    identity_markers: tuple = IDENTITY_MARKERS
    subunits: tuple = SUBUNITS
    unit_suffixes: tuple = UNIT_SUFFIXES
    brands: tuple = BRANDS
    longest_location: bool = False
    strict: bool = False


INSTITUTIONS = RuleSet()
#: No vocabulary at all: for masters of another kind.
PLAIN = RuleSet(
    aliases={}, parent_markers=(), institution_words=(), generic=(), abbreviation_stop=(), input_acronym_stop=(), domains=(), domain_groups={}, identity_noise=(), match_noise=(), typos={}, intents={}, verified={},
    verified_review={}, verified_absent=(), supplement=(), system_acronyms=(), system_phrases={}, families={}, delivery=(), subunits=(), unit_suffixes=(), brands=(), identity_markers=(),
)
