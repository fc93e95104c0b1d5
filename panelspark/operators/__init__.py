"""DataFrame operators over keyed panels."""
