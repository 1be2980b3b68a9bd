"""Declared schema of the edit log and the missing-value tokens.

The schema is fixed, never inferred.  'category' columns are plain strings
(dictionary encoding is the Parquet writer's job); float32 columns stay
``FloatType`` so feature values keep their precision, while sums and means
are computed in double.
"""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, FloatType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

INT, LONG, FLOAT, BOOL, STR, CAT, TS = "int", "long", "float", "bool", "str", "category", "datetime"

# The 124 declared input columns and their types, in the order
# of the declaration (meta, character, word, sentence, statement, user, item,
# revision, diff, labels).
DECLARED_COLUMNS: list[tuple[str, str]] = [
    # meta
    ("revisionId", LONG), ("commentTail", STR), ("contentType", CAT), ("groupId", LONG),
    ("itemId", LONG), ("timestamp", TS), ("userId", LONG), ("englishItemLabel", STR),
    ("superItemId", FLOAT), ("minorRevision", BOOL),
    # character
    ("alphanumericRatio", FLOAT), ("asciiRatio", FLOAT), ("bracketRatio", FLOAT),
    ("digitRatio", FLOAT), ("latinRatio", FLOAT), ("longestCharacterSequence", FLOAT),
    ("lowerCaseRatio", FLOAT), ("nonLatinRatio", FLOAT), ("punctuationRatio", FLOAT),
    ("upperCaseRatio", FLOAT), ("whitespaceRatio", FLOAT),
    # misc character
    ("arabicRatio", FLOAT), ("bengaliRatio", FLOAT), ("brahmiRatio", FLOAT),
    ("cyrillicRatio", FLOAT), ("hanRatio", FLOAT), ("hindiRatio", FLOAT),
    ("malayalamRatio", FLOAT), ("tamilRatio", FLOAT), ("teluguRatio", FLOAT),
    # word
    ("badWordRatio", FLOAT), ("containsLanguageWord", BOOL), ("containsURL", BOOL),
    ("languageWordRatio", FLOAT), ("longestWord", FLOAT), ("lowerCaseWordRatio", FLOAT),
    ("proportionOfQidAdded", FLOAT), ("proportionOfLinksAdded", FLOAT),
    ("proportionOfLanguageAdded", FLOAT), ("upperCaseWordRatio", FLOAT),
    # misc word
    ("containsBadWord", BOOL), ("containsLanguageWord2", BOOL),
    # sentence
    ("commentCommentSimilarity", FLOAT), ("commentLabelSimilarity", FLOAT),
    ("commentSitelinkSimilarity", FLOAT), ("commentTailLength", FLOAT),
    # misc sentence
    ("wordsFromCommentInText", FLOAT), ("wordsFromCommentInTextWithoutStopWords", FLOAT),
    # statement
    ("property", CAT), ("itemValue", CAT), ("literalValue", STR),
    # user
    ("isRegisteredUser", BOOL), ("isPrivilegedUser", BOOL), ("isBotUser", BOOL),
    ("userCity", CAT), ("userCountry", CAT), ("userCounty", CAT), ("userContinent", CAT),
    ("userName", CAT), ("userRegion", CAT), ("userTimeZone", CAT),
    # item
    ("hasListLabel", BOOL), ("isHuman", BOOL), ("labelCapitalizedWordRatio", FLOAT),
    ("labelContainsFemaleFirstName", BOOL), ("labelContainsMaleFirstName", BOOL),
    # misc item
    ("numberOfLabels", INT), ("numberOfDescriptions", INT), ("numberOfAliases", INT),
    ("numberOfStatements", INT), ("numberOfSitelinks", INT), ("numberOfQualifiers", INT),
    ("numberOfReferences", INT), ("numberOfBadges", INT), ("latestInstanceOfItemId", FLOAT),
    ("isLivingPerson", BOOL), ("latestEnglishItemLabel", STR),
    # revision
    ("commentLength", FLOAT), ("isLatinLanguage", BOOL), ("positionWithinSession", INT),
    ("revisionAction", CAT), ("revisionLanguage", CAT), ("revisionPrevAction", CAT),
    ("revisionSubaction", CAT), ("revisionTag", CAT), ("parentRevisionInCorpus", BOOL),
    # misc revision
    ("param1", FLOAT), ("param3", STR), ("param4", STR), ("bytesIncrease", FLOAT),
    ("revisionSize", INT), ("timeSinceLastRevision", FLOAT),
    # diff
    ("numberOfAliasesAdded", INT), ("numberOfAliasesRemoved", INT),
    ("numberOfBadgesAdded", INT), ("numberOfBadgesRemoved", INT),
    ("numberOfClaimsAdded", INT), ("numberOfClaimsChanged", INT), ("numberOfClaimsRemoved", INT),
    ("numberOfDescriptionsAdded", INT), ("numberOfDescriptionsChanged", INT),
    ("numberOfDescriptionsRemoved", INT),
    ("numberOfLabelsAdded", INT), ("numberOfLabelsChanged", INT), ("numberOfLabelsRemoved", INT),
    ("numberOfSitelinksAdded", INT), ("numberOfSitelinksChanged", INT),
    ("numberOfSitelinksRemoved", INT),
    ("numberOfIdentifiersChanged", INT), ("numberOfSourcesAdded", INT),
    ("numberOfSourcesRemoved", INT), ("numberOfQualifiersAdded", INT),
    ("numberOfQualifiersRemoved", INT),
    ("englishLabelTouched", BOOL), ("hasP21Changed", BOOL), ("hasP27Changed", BOOL),
    ("hasP54Changed", BOOL), ("hasP569Changed", BOOL), ("hasP18Changed", BOOL),
    ("hasP109Changed", BOOL), ("hasP373Changed", BOOL), ("hasP856Changed", BOOL),
    # labels
    ("undoRestoreReverted", BOOL), ("rollbackReverted", BOOL),
]

DECLARED: dict[str, str] = dict(DECLARED_COLUMNS)

# The cell texts that mean "missing".  The empty string is a
# value, not missing.
NULL_TOKENS = ["NA", "NaN", "null", "\ufffd"]
# Boolean cell texts and the timestamp format (UTC).
TRUE_TOKEN, FALSE_TOKEN = "T", "F"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"

META_COLUMNS = ["revisionId", "groupId", "contentType", "timestamp"]
LABEL_COLUMN = "rollbackReverted"

_SPARK_TYPES = {INT: IntegerType(), LONG: LongType(), FLOAT: FloatType(), BOOL: BooleanType(),
                STR: StringType(), CAT: StringType(), TS: TimestampType()}


def spark_type(kind: str):
    return _SPARK_TYPES[kind]


def struct(columns: list[str] | None = None) -> StructType:
    cols = columns if columns is not None else [c for c, _ in DECLARED_COLUMNS]
    return StructType([StructField(c, spark_type(DECLARED.get(c, STR)),
                                   nullable=(c != "revisionId")) for c in cols])
