"""Tables of the engine, and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


def _table(text: str) -> StructType:
    kinds = {"string": StringType(), "int": IntegerType(), "long": LongType(), "strings": ArrayType(StringType()), "ints": ArrayType(IntegerType())}
    return StructType([StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in text.split())])


VOLUME = StructType([StructField(n, t) for n, t in (("title", StringType()), ("label", StringType()), ("start", IntegerType()), ("end", IntegerType()))])
SERIES = StructType([StructField("name", StringType()), StructField("position", IntegerType())])
BOOKS = StructType([*_table("book_id:string title:string author:string content_type:string source_format:string source_filename:string ingested_at:string chapter_count:int").fields, StructField("series", SERIES), StructField("volumes", ArrayType(VOLUME))])
INDEX = StructType([*_table("book_id:string title:string author:string").fields, StructField("series", SERIES), StructField("ord", LongType())])
CHAPTERS = _table("book_id:string index:int title:string text:string pages:ints")
FACTS = _table("book_id:string seq:long entity_id:string entity_name:string chapter_index:int category:string statement:string when:string time_phrase:string")
ENTITIES = _table("entity_id:string canonical_name:string type:string aliases:strings epithets:strings book_ids:strings ord:long")
DECLARED = _table("book_id:string gseq:int names:strings epithets:strings reason:string")
CHECKPOINTS = _table("book_id:string chapter_count:int next_chapter_index:int provider:string")
EXTRACTED = _table("entity_name:string entity_type:string category:string statement:string when:string time_phrase:string")

# Taxonomies, aliases and limits of extracted facts.
ENTITY_TYPES = {"fiction": ("character", "setting", "theme"), "nonfiction": ("character", "concept", "theme")}
ENTITY_TYPE_ALIASES = {"fiction": {"monster": "character", "creature": "character"}, "nonfiction": {}}
CATEGORIES = {
    "fiction": ("personality", "appearance", "relationship", "status", "description", "development"),
    "nonfiction": ("definition", "claim", "technique", "example", "relationship", "description"),
}
OCCURRENCES = {"fiction": ("status", "development", "relationship"), "nonfiction": ()}
WHEN = ("present", "past", "future")
WHEN_ALIASES = {
    "now": "present", "current": "present", "currently": "present",
    "backstory": "past", "before": "past", "earlier": "past", "previously": "past",
    "later": "future", "planned": "future", "anticipated": "future",
}
LIST_KEYS = ("facts", "results", "data", "items")
SUSPICIOUS = ("entity_name", "entity_type")
MAX_STATEMENT, MAX_TIME_PHRASE, MAX_FACTS, SCHEMA_STATEMENT = 500, 80, 40, 300

# Word lists.
QUESTION_STOPWORDS = tuple(
    """a an the and or but if of in on at to from by for with without about into over under
    is are was were be been being has have had do does did doing will would can could should
    what who whom whose which when where why how that this these those there here it its it's
    he she they them his her their him us we you your i me my mine our ours
    not no nor so than then too very just also only own same s t don now
    tell me more something anything someone anyone happen happened happens happening
    say says said tell tells told know knows knew like likes liked""".split()
)
PASSAGE_STOPWORDS = tuple(
    """a an the and or but if then than that this these those of to in on at by for with from
    as is are was were be been being am do does did done has have had having it its he she they
    them his her their him not no nor so such very can could will would shall should may might
    must about into over under after before while when where who whom which what there here""".split()
)
FAKE_STOPWORDS = ("The", "A", "An", "I", "He", "She", "They", "It", "We", "You")
SMALL_TITLE_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to")
NAME_CONNECTORS = ("of", "the", "a", "an", "and", "de", "du", "di", "la", "le", "van", "von")
PROPER_NOUN_TYPES = ("character", "setting")
CONJUNCTIONS = ("and", "&", "or", "plus", "with")
TITLES = tuple(
    """sir lady lord king queen prince princess duke duchess baron baroness
    count countess earl master mistress mister mr mrs ms miss dr doctor
    professor father mother brother sister uncle aunt cousin captain commander
    lieutenant sergeant colonel general admiral ranger squire apprentice
    cadet senior junior saint st""".split()
)
NAMING_PHRASES = ("called", "nicknamed", "known as", "goes by", "went by", "short for", "or just", "or simply")
DETERMINERS = tuple("the a an this that these those its his her their my your our each every another some any no".split())
PERSON_SPEECH_VERBS = (
    "said says asked asks replied replies answered answers shouted shouts muttered whispered nodded nods smiled smiles "
    "laughed laughs sighed grinned frowned exclaimed murmured chuckled snorted sneered shrugged growled hissed stammered retorted snapped"
).split()
TAG_SPEECH_VERBS = (
    "said says asked asks replied answered answers muttered snapped growled whispered shouted called added cried demanded "
    "observed remarked agreed admitted hissed murmured repeated began continued"
).split() + ["put in", "went on"]
NOT_A_VOCATIVE = tuple(
    """yes no well hello hullo hi now here there then too what oh ah ahh ahhh eh
    please right righty righty-o listen look see really but and so why wait aye
    good better best thank thanks sure maybe course indeed nonsense of all just
    still even though because after before first next finally anyway besides
    actually certainly exactly true false nope yeah yep say sorry excuse""".split()
)
TERMS_OF_ADDRESS = tuple("sir dear madam ma'am maam boss mate lord lady master mistress friend".split())
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()

# Thresholds.
MIN_NARRATIVE_WORDS = 20
FUZZY_RATIO, MAX_STATEMENT_MATCHES, RARITY_DIVISOR = 0.8, 80, 10
MIN_PASSAGE_SCORE, PAIR_PENALTY, UNSEEN_IDF, MAX_QUOTE = 0.40, 0.95, 1.0, 220
CONSOLIDATE_BELOW, CONSOLIDATE_TARGET = 600, 2000
SPLIT_THRESHOLD, SPLIT_TARGET, SPLIT_OVERLAP = 3500, 1800, 150
MIN_VOLUMES, MIN_VOLUME_WORDS, MIN_COVERAGE = 2, 1000, 0.85
MIN_DECORATED, MIN_BARE, MIN_LOWERCASE, PROPOSE_RATIO, AUTOLINK_RATIO = 10, 100, 25, 3.0, 5.0
MAX_DETERMINER_SHARE, MIN_SPEECH_SIGHTINGS = 0.10, 3
FIRST_PERSON_DENSITY, MIN_NARRATION_WORDS, MIN_ADDRESSED, MAX_UTTERANCE = 4.0, 50, 2, 400
CAPITALISED_SHARE, MIN_RIVAL_CHAPTERS, MOSTLY_FIRST_PERSON = 0.8, 2, 0.5
NEAR_DUPLICATE = 0.6
TOKENS_PER_WORD, PROMPT_TOKENS, MIN_WINDOW = 1.25, 2600, 4096
