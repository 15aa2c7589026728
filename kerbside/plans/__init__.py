"""Composed questions: reports, the district, registered queries."""
