import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import at

from annalist.functions.periods import Sampling
from annalist.operators import activity

ALIASES = (
    "D 3D B W W-WED 2W 3W-MON M 2M MS 3MS Q Q-NOV 2Q QS QS-FEB Y YE-MAR YS 2Y BM BMS BQ BQS BY BYS H 5H 90min 7H "
    "SM 2SM SMS 3SMS 1D12H 1h30min 2H15min"
).split()


def expected_series(times, alias):
    modern = {"M": "ME", "2M": "2ME", "Q": "QE", "Q-NOV": "QE-NOV", "2Q": "2QE", "Y": "YE", "2Y": "2YE"}
    modern.update({"BM": "BME", "BQ": "BQE", "BY": "BYE", "H": "h", "5H": "5h", "7H": "7h"})
    modern.update({"SM": "SME", "2SM": "2SME", "1D12H": "36h", "1h30min": "90min", "2H15min": "135min"})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        frame = pd.Series(1, index=pd.to_datetime(times, unit="s"))
        counted = frame.groupby(pd.Grouper(freq=modern.get(alias, alias))).count()
    return [(int(k.timestamp()), int(v)) for k, v in counted.items()]


@pytest.mark.parametrize("alias", ALIASES)
def test_series_equal_calendar_resampling(spark, alias):
    """Labels, anchors of multiples and empty periods, times before 1970 included."""
    rng = np.random.default_rng(7)
    times = np.sort(rng.integers(-20_000_000, 15_000_000, 40))
    times = [int(t) for t in [*times, *(times[:6] // 86400 * 86400)]]
    history = activity.commit_history(at(spark, times), alias)
    label = F.unix_seconds("period") if Sampling.parse(alias).is_clock else F.unix_date("period") * 86400
    found = [(r[0], r[1]) for r in history.select(label, "commits_count").collect()]
    assert found == expected_series(times, alias)


@pytest.mark.parametrize("alias", ["", "X", "W-XXX", "M-MON", "0D", "0D0H", "DX", "1D2W", "2", "W2"])
def test_other_aliases_are_refused(alias):
    with pytest.raises(ValueError):
        Sampling.parse(alias)


def test_seconds_over_days_do_not_build_one_long_row(spark):
    history = activity.commit_history(at(spark, [1_700_000_000, 1_700_050_000]), "S")
    assert history.count() == 50_001
    assert history.agg(F.sum("commits_count")).first()[0] == 2


def test_empty_history_has_no_periods(spark):
    assert activity.commit_history(at(spark, [1]).filter("false"), "W").count() == 0
