"""Query plans over the project's tables; each module offers QUERIES and, where SQL can say it, SQL."""

from strandline.plans import attention, claims, collection, flow, grounding, known, reliability, reports, retrieval

ALL = (reliability, retrieval, collection, claims, attention, reports, grounding, flow, known)
