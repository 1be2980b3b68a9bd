"""Feature sets of the real edit log, over the columns of ``sources.schema``.

``main``, ``filter_baseline`` and ``diff_baseline`` are the three systems of a run;
``misc`` holds features that are offered but not part of a system.  Columns without an
imputing step (and the keys of running counts) must not be missing: a missing feature
value stops a run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from ..operators import steps as ST
from .catalog import Feature, grouped


def _raw(*columns: str) -> list[Feature]:
    return [Feature(c) for c in columns]


def _filled(step: Callable, *columns: str) -> list[Feature]:
    return [Feature(c, [step()]) for c in columns]


def _counted(**columns: str | Sequence[str]) -> list[Feature]:
    """Frequencies: output name = column, or columns whose tuple is counted."""
    return [Feature(inputs, [ST.frequency()], out) for out, inputs in columns.items()]


def _logged(**columns: str) -> list[Feature]:
    return [Feature(c, [ST.log_scale()], out) for out, c in columns.items()]


# Input columns, steps, output names and groups of every set.

def main() -> list[Feature]:
    """The main system: 47 features."""
    median, minus_one = ST.impute_median, ST.impute_minus_one
    return grouped({
        "contextual": {
            "user": [
                *_raw("isRegisteredUser", "isPrivilegedUser"),
                *_counted(userCityFreq="userCity", userCountryFreq="userCountry", userCountyFreq="userCounty",
                          userContinentFreq="userContinent", userFreq="userName"),
                Feature(["userName", "itemId"], [ST.cum_unique()], "cumUserUniqueItems"),
                *_counted(userRegionFreq="userRegion", userTimeZoneFreq="userTimeZone"),
            ],
            "item": [
                Feature(["itemId", "userName"], [ST.cum_unique(), ST.log_scale()], "logCumItemUniqueUsers"),
                Feature("itemId", [ST.frequency(), ST.log_scale()], "logItemFreq"),
            ],
            "revision": [
                *_filled(minus_one, "commentLength"),
                *_filled(ST.impute_boolean, "isLatinLanguage"),
                *_raw("positionWithinSession"),
                *_counted(revisionActionFreq="revisionAction", revisionLanguageFreq="revisionLanguage",
                          revisionPrevActionFreq="revisionPrevAction", revisionSubactionFreq="revisionSubaction",
                          revisionTagFreq="revisionTag"),
            ],
        },
        "content": {
            "character": [
                *_filled(median, "alphanumericRatio", "asciiRatio", "bracketRatio", "digitRatio", "latinRatio"),
                *_filled(minus_one, "longestCharacterSequence"),
                *_filled(median, "lowerCaseRatio", "nonLatinRatio", "punctuationRatio", "upperCaseRatio",
                         "whitespaceRatio"),
            ],
            "word": [
                *_filled(median, "badWordRatio"),
                *_raw("containsLanguageWord", "containsURL"),
                *_filled(median, "languageWordRatio"),
                *_filled(minus_one, "longestWord"),
                *_filled(median, "lowerCaseWordRatio"),
                *_raw("proportionOfQidAdded", "proportionOfLinksAdded"),
                *_filled(median, "upperCaseWordRatio"),
            ],
            "sentence": _filled(minus_one, "commentCommentSimilarity", "commentLabelSimilarity",
                                "commentSitelinkSimilarity", "commentTailLength"),
            "statement": _counted(literalValueFreq="literalValue", itemValueFreq="itemValue",
                                  propertyFreq="property"),
        },
    })


def filter_baseline() -> list[Feature]:
    """One feature: how often the revision's tag occurs."""
    return grouped({"filter": {"filter": _counted(revisionTagFreq="revisionTag")}})


def diff_baseline() -> list[Feature]:
    """The diff baseline: 45 features."""
    return grouped({"baseline": {"diff": [
        *_raw("numberOfSitelinksAdded", "numberOfSitelinksRemoved", "numberOfSitelinksChanged",
              "numberOfLabelsAdded", "numberOfLabelsRemoved", "numberOfLabelsChanged",
              "numberOfDescriptionsAdded", "numberOfDescriptionsRemoved", "numberOfDescriptionsChanged",
              "numberOfAliasesAdded", "numberOfAliasesRemoved",
              "numberOfClaimsAdded", "numberOfClaimsRemoved", "numberOfClaimsChanged",
              "numberOfIdentifiersChanged", "englishLabelTouched",
              "numberOfSourcesAdded", "numberOfSourcesRemoved",
              "numberOfQualifiersAdded", "numberOfQualifiersRemoved",
              "numberOfBadgesAdded", "numberOfBadgesRemoved",
              "proportionOfQidAdded", "proportionOfLinksAdded", "proportionOfLanguageAdded",
              "hasP21Changed", "hasP27Changed", "hasP54Changed", "hasP569Changed",
              "hasP18Changed", "hasP109Changed", "hasP373Changed", "hasP856Changed",
              "numberOfLabels", "numberOfDescriptions", "numberOfAliases", "numberOfStatements",
              "numberOfSitelinks", "numberOfQualifiers", "numberOfReferences", "numberOfBadges",
              "isLivingPerson"),
        *_filled(ST.impute_boolean, "isHuman"),
        *_raw("isBotUser", "isRegisteredUser"),
    ]}})


def misc() -> list[Feature]:
    """44 further features outside the three systems."""
    median, boolean = ST.impute_median, ST.impute_boolean
    return grouped({
        "contextual": {
            "user": [
                Feature(["userName", "timestamp"], [ST.time_since_previous(), median()],
                        "userTimeSinceLastRevision"),
                Feature(["userName", "bytesIncrease"], [ST.group_mean(null_safe=True)], "userMeanBytesIncrease"),
                *_counted(userContentTypeFreq=["userName", "contentType"]),
            ],
            "item": [
                *_filled(boolean, "hasListLabel", "isHuman"),
                *_filled(median, "labelCapitalizedWordRatio"),
                *_filled(boolean, "labelContainsFemaleFirstName", "labelContainsMaleFirstName"),
                *_raw("numberOfLabels", "numberOfDescriptions", "numberOfAliases", "numberOfStatements",
                      "numberOfSitelinks", "numberOfQualifiers", "numberOfReferences", "numberOfBadges"),
                *_logged(logNumberOfLabels="numberOfLabels", logNumberOfDescriptions="numberOfDescriptions",
                         logNumberOfAliases="numberOfAliases", logNumberOfStatements="numberOfStatements",
                         logNumberOfSitelinks="numberOfSitelinks", logNumberOfQualifiers="numberOfQualifiers",
                         logNumberOfReferences="numberOfReferences", logNumberOfBadges="numberOfBadges"),
            ],
            "revision": [
                *_raw("revisionSize"),
                *_logged(logRevisionSize="revisionSize"),
                Feature("timestamp", [ST.time_unit("hourOfDay")], "revisionHourOfDay"),
                Feature("timestamp", [ST.time_unit("dayOfWeek")], "revisionDayOfWeek"),
                Feature("timestamp", [ST.time_unit("dayOfMonth")], "revisionDayOfMonth"),
            ],
        },
        "content": {
            "character": _filled(median, "arabicRatio", "bengaliRatio", "brahmiRatio", "cyrillicRatio",
                                 "hanRatio", "malayalamRatio", "tamilRatio", "teluguRatio"),
            "word": _raw("proportionOfLanguageAdded"),
            "sentence": _filled(ST.frequency, "commentTail"),
            "statement": _counted(superItemFreq="superItemId", propertyItemFreq=["property", "itemId"],
                                  propertySuperItemFreq=["property", "superItemId"],
                                  itemValuePropertyFreq=["itemValue", "property"],
                                  literalValuePropertyFreq=["literalValue", "property"]),
        },
    })


SYSTEMS = {"MAIN": main, "FILTER": filter_baseline, "BASELINE": diff_baseline}
