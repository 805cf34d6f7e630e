"""Column functions and the shared exact rank / running-total builders."""
