"""Physical-plan helpers shared by the operators: staging, ordering, joins."""
