"""Fixed parameters of the registered queries (viewers, search text, ids)."""

# A member of two teams (T10 as member, T17 as member); not global.
MEMBER = "customer.000000003@example.com"
# A manager of T10.
MANAGER = "customer.000000004@example.com"
# A superadmin (global).
GLOBAL = "customer.000000001@example.com"
# An account without any team.
LONER = "customer.000000009@example.com"

TEAM = "T10"
TEAMS = ["T10", "T17"]
SEARCH_Q = "Bolt"
USER_Q = "00000001"
FILTER_SOURCE = "snowflake"
FILTER_LAYER = "L2"
LOOKUP_IDS = ["A1", "A2", "A10", "A999999"]
PAGE_LIMIT = 100
PAGE_OFFSET = 10
PER_VIEWER = 100  # the listing default page size
