"""Sources and sinks: the driver's parquet tables, CSV scan/sink with explicit
schemas, and the travel-time tables derived from them."""

from ridecast.sources.csv_io import read_csv, read_csv_many, write_csv  # noqa: F401
from ridecast.sources.tables import TABLES, load, load_all  # noqa: F401
