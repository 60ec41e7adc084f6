"""Fixed values of the matching rules. They are data, kept together and in the order in which they apply."""

from __future__ import annotations

#: Domains that say nothing about who owns a page (exact, or as a suffix after a dot).
IGNORED_DOMAINS = tuple(
    """facebook.com fb.com messenger.com twitter.com x.com instagram.com threads.net linkedin.com youtube.com youtu.be
    tiktok.com bit.ly t.co goo.gl tinyurl.com ow.ly shorturl.at buff.ly rebrand.ly cutt.ly tiny.cc medium.com
    wordpress.com blogger.com tumblr.com pinterest.com reddit.com snapchat.com whatsapp.com telegram.org discord.com
    discord.gg twitch.tv googleusercontent.com forms.gle docs.google.com drive.google.com sites.google.com
    blogspot.com wordpress.org wix.com weebly.com squarespace.com godaddysites.com jimdofree.com eventbrite.com
    meetup.com zoom.us linktr.ee calendly.com github.io gitlab.io""".split()
)

GENERIC_MAILBOXES = ("info", "contact", "office", "admin")
GMAIL_DOMAINS = ("gmail.com", "googlemail.com")
REJECTED_URL_PREFIXES = ("mailto:", "tel:", "ftp:")

#: Slugs shared -> confidence; whole paths that agree, or two urls without a path, have the first.
URL_FULL_CONFIDENCE = 0.96
URL_SLUG_CONFIDENCE = (0.70, 0.80, 0.88, 0.92)

#: Street words, as whole words between spaces.
STREET_WORDS = (
    ("st", "street"), ("str", "street"), ("rd", "road"), ("ave", "avenue"), ("av", "avenue"), ("blvd", "boulevard"), ("blv", "boulevard"),
    ("dr", "drive"), ("ln", "lane"), ("ct", "court"), ("pl", "place"), ("sq", "square"), ("pkwy", "parkway"), ("cir", "circle"),
)
#: Words that open a unit; they go with the word that follows.
UNIT_WORDS = ("apt", "apartment", "suite", "ste", "unit", "#", "bldg", "building", "fl", "floor", "dept", "department", "room", "rm", "po box", "p o box", "p.o. box")
#: Words looked for, in this order, when the unit itself is wanted.
UNIT_PATTERNS = ("apt", "apartment", "suite", "ste", "unit", "#", "bldg", "building", "fl", "floor", "room", "rm")

NOISE_PREFIXES = ("zzz - ", "re-add ")
NAME_CHARACTERS = (("&", " and "), ("+", " plus "), ("/", " "), ("-", " "), (".", " "), ("'", ""), ("(", " "), (")", " "), (",", " "))
NAME_ARTICLES = ("the ", "a ", "an ")
NAME_SUFFIXES = (
    "incorporated", "inc.", "inc", "corporation", "corp.", "corp", "limited liability company", "llc.", "llc", "limited", "ltd.", "ltd",
    "limited partnership", "lp.", "lp", "limited liability partnership", "llp.", "llp", "foundation", "trust", "charitable trust", "company", "co.", "co",
    "non-profit", "nonprofit", "nfp", "association", "assn.", "assn", "coop", "co-op", "cooperative", "npo", "organisation", "organization", "org.", "org",
    "coalition", "fund", "partnership", "academy", "consortium", "institute", "services", "group", "society", "network", "federation", "international",
    "global", "national", "alliance", "gmbh", "ag", "sarl", "bv", "spa", "pty", "plc", "p.c.", "pc",
)
NAME_ABBREVIATIONS = (
    (r"\b(ctr|cntr|cent|cen)\b", "center"), (r"\b(assoc|assn)\b", "association"), (r"\b(dept|dpt)\b", "department"), (r"\b(intl|int'l)\b", "international"),
    (r"\b(nat'l|natl)\b", "national"), (r"\b(comm|cmty)\b", "community"), (r"\b(srv|svcs|serv|svc)\b", "service"), (r"\b(univ)\b", "university"),
    (r"\b(coll)\b", "college"), (r"\b(inst)\b", "institute"), (r"\b(mfg)\b", "manufacturing"), (r"\b(tech)\b", "technology"), (r"\b(st)\b", "saint"),
    (r"\bwa\b", "washington"), (r"\b(fd)\b", "fire department"), (r"\b(pd)\b", "police department"),
    (r"\binc\b", ""), (r"\bcorp\b", ""), (r"\bllc\b", ""), (r"\bltd\b", ""),
)
#: Part of a name -> kind of organisation, first hit counts.
TYPE_RULES = (
    ("city of", "city"), ("county", "county"), ("police department", "police"), ("fire department", "fire"), ("hospital", "hospital"),
    ("medical center", "hospital"), ("health", "health"), ("school district", "education"), ("school", "education"), ("college", "education"),
    ("university", "education"), ("church", "religious"), ("food bank", "food"), ("library", "library"), ("senior center", "senior"),
    ("ymca", "recreation"), ("community center", "community"),
)
#: Replacements inside names of a kind, in order.
TYPE_REPLACEMENTS = {
    "police": (("pd", "police department"), ("police dept", "police department")),
    "fire": (("fd", "fire department"), ("fire dept", "fire department")),
    "hospital": (("medical center", "hospital"), ("med ctr", "hospital"), ("med center", "hospital")),
    "education": (("school dist", "school district"), ("sd", "school district")),
}
INCOMPATIBLE_TYPES = (
    ("fire", "police"), ("fire", "school"), ("police", "school"), ("hospital", "school"), ("hospital", "church"), ("health", "education"),
    ("medical", "food"), ("college", "hospital"), ("prison", "school"), ("shelter", "college"),
)
LOCATION_PREFIXES = ("north", "south", "east", "west", "sound", "valley", "pacific", "olympic")
DEPARTMENT_KINDS = ("police", "fire", "health", "public", "revenue", "transportation")
STOPWORDS = tuple(
    """a an the and or but nor for yet so in on at by to with from of as into about before after during until since unless
    inc incorporated corp corporation llc ltd limited company co group holdings enterprises international global worldwide
    national american usa us service services solutions systems associates partners partnership organization organisation
    foundation institute association society council committee center centre department division unit office bureau agency
    authority board new old great greater best better first second third primary main central local regional official this
    that these those it they them their our your all any each every some such no not only very program community resource
    resources support help health care management professional public private general federal state county d""".split()
)
HEAVY_TOKENS = ("police", "fire", "hospital", "school", "college", "church", "bank", "library")
LIGHT_TOKENS = ("the", "and", "of", "in", "for", "at", "with", "by", "on", "to", "service", "services", "center", "association", "organization")

#: Target confidences of each method's arms.
ARMS = {
    "email": (0.85, 0.90, 0.95, 0.98, 1.0),
    "phone": (0.80, 0.85, 0.90, 0.95, 0.98),
    "url": (0.80, 0.85, 0.90, 0.95),
    "address": (0.75, 0.80, 0.85, 0.90, 0.95),
    "name": (0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.95),
    "geospatial": (0.70, 0.75, 0.80, 0.85, 0.90),
    "default": (0.70, 0.80, 0.85, 0.90),
}
FALLBACK_CONFIDENCE = 0.85

SUGGESTION_CONFIDENCE = 0.85
CRITICAL_CONFIDENCE = 0.30
WEAK_LINK_WEIGHT = 0.1
VERIFICATION_COHERENCE = 0.7
LEIDEN_RESOLUTION = 1.0
SERVICE_SIMILARITY = 0.85
SERVICE_METRES = 2000.0
GEO_METRES = 241.4016
PROXIMITY_METRES = 10_000.0
EARTH_METRES = 6_371_008.8
