from strictpast.functions.columns import *  # noqa: F403
