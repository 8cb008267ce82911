"""Default stop words for topic terms.

Every operator that drops stop words takes the list as a parameter; this
default is Spark's own English list without its contractions, which can
never equal a word token.
"""

# English function words.
ENGLISH = (
    "about above after again against all am an and any are as at be because been before being "
    "below between both but by can cannot could did do does doing don down during each few for "
    "from further had has have having he her here hers herself him himself his how if in into "
    "is it its itself just me more most my myself no nor not now of off on once only or other "
    "ought our ours ourselves out over own same she should so some such than that the their "
    "theirs them themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with would you your yours "
    "yourself yourselves"
).split()
