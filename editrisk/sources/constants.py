"""Split boundaries of the real revision corpus.

Fixed values: the first revision ids of 2013-05-01, 2014-07-01, 2014-09-01
and 2014-11-01 (UTC), and the backtest calendar (start, window and step in
months, last test start).
"""

TRAINING_SET_START = 33066010
VALIDATION_SET_START = 141847961
TEST_SET_START = 154770707
TAIL_SET_START = 169728772

BACKTEST_TRAINING_START = "2013-05-01 00:00:00"
BACKTEST_VALIDATION_MONTHS = 2
BACKTEST_STEP_MONTHS = 2
BACKTEST_END = "2014-11-01 00:00:00"


def revision_bounds(use_test_set: bool) -> tuple[int, int, int]:
    """(training start, validation start, test start) ids of a run: the
    validation run validates on [VALIDATION, TEST), the test run on [TEST, TAIL)."""
    if use_test_set:
        return TRAINING_SET_START, TEST_SET_START, TAIL_SET_START
    return TRAINING_SET_START, VALIDATION_SET_START, TEST_SET_START
