from .tables import Tables, TABLE_NAMES  # noqa: F401
from .files import (require_columns, read_csv, write_csv, read_json, write_json,  # noqa: F401
                    read_optional, write_latest)
