import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FLIGHT_SCHEMA = ("flight_id string, FlightDate date, Year int, Month int, Origin string, Dest string, "
                 "CRSDepTime double, CRSArrTime double, ArrDelay double, DepDelay double, WeatherDelay double, "
                 "LateAircraftDelay double, AirTime double, Cancelled double")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hubrisk.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, driver_memory="8g")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def params():
    from hubrisk.params import Params
    return Params(hub="HUB", train_years=(2019,), test_year=2024)


def flight(fid, date, origin, dest, crs=None, arr_delay=0.0, dep_delay=0.0, wx=0.0, late=0.0, airtime=100.0,
           cancelled=0.0):
    import datetime as dt
    d = dt.date.fromisoformat(date)
    return (fid, d, d.year, d.month, origin, dest, crs, crs, arr_delay, dep_delay, wx, late, airtime, cancelled)


@pytest.fixture(scope="session")
def make_flights(spark):
    def make(rows):
        return spark.createDataFrame(rows, FLIGHT_SCHEMA)
    return make
