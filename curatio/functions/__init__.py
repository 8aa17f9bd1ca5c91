from curatio.functions.hashing import draw, hkey, sql_draw, sql_hkey  # noqa: F401
from curatio.functions import text  # noqa: F401
