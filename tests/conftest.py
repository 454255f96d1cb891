import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shop(tmp_path):
    """A folder of typed CSV tables with blanks, quotes, CRLF, an unpadded hour and a reference to nothing."""
    folder = tmp_path / "shop"
    folder.mkdir()
    (folder / "Staff.csv").write_bytes(b"Staff_id (N) (P),Name (T),Pay (N),Joined (D)\r\n1,Ann,70000.55,2019-07-14\r\n2,Bo,50000.1,2021-07-10 9:15:00\r\n3,Cy,,2020-01-01 00:00:00\r\n4,\"Day, D\",99.99,\r\n")
    (folder / "Goods.csv").write_bytes(b"Goods_id (N) (P),Title (T),Price (N),Since (D)\n101,Lamp,99.99,2022-05-01 10:00:00\n102,Bolt,15.5,2021-03-04 11:30:00\n103,,45.75,2023-01-01 00:00:00\n104,Old,3,2019-01-01 00:00:00")
    (folder / "Sales.csv").write_bytes(b"Sales_id (N) (P),Goods_id (N),Staff_id (N),Total (N),Day (D)\n1,101,1,250.5,2022-06-01 00:00:00\n2,102,1,300.25,2022-06-02 00:00:00\n3,103,2,150,2022-06-03 00:00:00\n4,106,2,500,2022-06-04 00:00:00\n5,101,,75.25,2022-06-05 00:00:00\n")
    (folder / "Empty.csv").write_text("Empty_id (N) (P),Note (T)\n")
    return str(folder)
