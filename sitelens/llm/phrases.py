"""Sentences the residue models start from: usual messages of web servers, themes and page builders, in this library's own selection.

None is taken from the tables; what a corpus says in its own words is learned from it (see ``PageModel``).
"""

#: Notices of pages that failed, refuse, wait or need scripts.
OPENERS = ["", "", "", "Sorry, ", "Oops! ", "Oh no! ", "Hello. ", "Please note: ", "Warning: ", "Whoops, ", "We are sorry, but ", "Error: ", "Ups, ", "Désolé, ", "Lo sentimos, ", "Leider "]
NOTICES = [
    "404 Not Found", "Page not found", "Not Found", "404", "Error 404", "The requested URL was not found on this server.", "We can't find that page.", "That page can't be found.", "We could not find what you were looking for.", "The page you requested does not exist or has been removed.",
    "The page may have been moved, renamed or deleted.", "This link is broken or out of date.", "No such file or directory.", "It looks like nothing was found at this location. Maybe try a search?", "The address may be mistyped.", "410 Gone", "The requested resource is no longer available on this server.", "Nothing here",
    "Return to the homepage.", "Go to the home page or use the search.", "Please check the spelling of the address.", "Here are some links that may help you.", "Try one of the pages below instead.",
    "500", "Error 500", "500 Internal Server Error", "Internal Server Error", "Server error", "Application error", "The server encountered an internal error and was unable to complete your request.", "An error occurred while processing your request.", "An unknown error has occurred.", "Something broke on our side.", "Something went wrong",
    "Our staff has been notified and is working on it.", "We are working to fix the problem.", "Fatal error: uncaught exception in index.php on line 12", "Traceback (most recent call last): File app.py, line 88, in render: key error", "Stack trace: at main.js line 40", "Could not connect to the database server.", "Error establishing a database connection", "The connection to the server was lost.",
    "502", "502 Bad Gateway", "503", "503 Service Unavailable", "Service unavailable", "504 Gateway Time-out", "The upstream server took too long to respond.", "The origin web server is not reachable.", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.", "Reference number: 18.2f3a", "Request ID: 9f3c1a77", "Incident code 1020", "If the problem persists contact the administrator.", "Please try again in a few minutes.", "Reload the page to try once more.",
    "403", "403 Forbidden", "Forbidden", "Access denied", "Access to this page has been denied.", "You don't have permission to access this resource.", "You are not authorized to view this page.", "Please sign in to continue.", "Members only. Log in to read on.", "Your IP address has been blocked.", "This content is unavailable in your region.", "For legal reasons the page is unavailable where you are.",
    "429 Too Many Requests", "Too many requests", "You have sent too many requests in a given amount of time.", "Rate limit exceeded, please slow down.", "Unusual traffic was detected from your network.", "Checking if the site connection is secure", "Verify you are human by completing the action below.", "Please complete the captcha to continue.", "Attention required!", "Your request looks automated, prove that you are no robot.", "Please wait while we are checking your browser.", "You will be redirected in a few seconds.", "Just a moment...", "One moment, please",
    "This domain name is for sale.", "Buy this domain. Make an offer.", "This domain is parked by its registrar.", "Parked domain", "Coming soon", "Website coming soon", "Our new website is on its way.", "We are launching soon, stay tuned.", "Our new online store will open shortly.", "Under construction", "This page is still under construction.", "Maintenance mode", "Site under maintenance", "Scheduled maintenance in progress, we will be back shortly.", "We'll be back soon", "The website is offline while we install updates.", "The store is temporarily closed for updates.", "Check back later.", "Sign up to be notified when we launch.", "Enter your e-mail and we let you know.", "It works!", "If you see this page, the web server is installed and needs further configuration.",
    "JavaScript is required", "JavaScript is turned off", "Please enable JavaScript to view this page.", "Enable JavaScript and reload the page.", "This application requires JavaScript to run.", "You need to enable JavaScript to run this app.", "For full functionality of this site it is necessary to enable JavaScript.", "Your browser does not support scripts or has them switched off.", "Your browser blocked the scripts that this page needs.", "The content of this page can't be displayed without scripts.", "Allow scripts and cookies in your settings and try again.", "This site doesn't work properly without JavaScript enabled.", "Here are the instructions how to enable it in your browser.", "Loading, please wait", "Loading...",
    "Seite nicht gefunden", "Die angeforderte Seite konnte nicht gefunden werden.", "Diese Seite existiert nicht oder wurde verschoben.", "Der Link ist veraltet oder falsch.", "Hier gibt es leider nichts zu sehen.", "Interner Serverfehler", "Ein unerwarteter Fehler ist aufgetreten.", "Die Verbindung zur Datenbank ist fehlgeschlagen.", "Bitte versuchen Sie es in einigen Minuten erneut.", "Bitte versuchen Sie es später erneut.", "Interner Fehler", "Zugriff verweigert", "Sie haben keine Berechtigung für diese Seite.", "Zu viele Anfragen", "Aus Ihrem Netzwerk kamen zu viele Anfragen.", "Bitte bestätigen Sie, dass Sie kein Roboter sind.", "Wartungsarbeiten", "Wir führen gerade Wartungsarbeiten durch und sind bald wieder da.", "Diese Website befindet sich im Aufbau.", "Diese Domain steht zum Verkauf.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Diese Anwendung benötigt JavaScript.", "Ihr Browser hat die Skripte dieser Seite blockiert.", "Der Inhalt kann ohne Skripte nicht dargestellt werden.", "Zur Startseite",
    "Página no encontrada", "La página solicitada no existe o ha sido eliminada.", "No hemos podido encontrar esta página.", "El enlace está roto o ha caducado.", "Aquí no queda nada que ver.", "Error interno del servidor", "Se ha producido un error inesperado.", "No se pudo conectar con la base de datos.", "Vuelva a intentarlo en unos minutos.", "Por favor, inténtelo más tarde.", "Error interno", "Acceso denegado", "No tiene permiso para ver esta página.", "Demasiadas peticiones", "Hemos recibido demasiadas peticiones desde su red.", "Confirme que no es un robot.", "Sitio web en mantenimiento, estaremos de vuelta pronto.", "Página web en construcción", "Este dominio está en venta.", "Active JavaScript en su navegador.", "Esta aplicación necesita JavaScript.", "Su navegador ha bloqueado los scripts de esta página.", "El contenido no se puede mostrar sin scripts.", "Volver a la página de inicio",
    "Page introuvable", "La page que vous cherchez n'existe pas ou a été supprimée.", "Nous n'avons pas trouvé cette page.", "Ce lien est cassé ou périmé.", "Il n'y a rien ici.", "Erreur interne du serveur", "Une erreur inattendue est survenue.", "La connexion à la base de données a échoué.", "Veuillez réessayer dans quelques minutes.", "Veuillez réessayer plus tard.", "Erreur interne", "Accès refusé", "Vous n'avez pas la permission de voir cette page.", "Trop de requêtes", "Votre réseau a envoyé trop de requêtes.", "Confirmez que vous n'êtes pas un robot.", "Site en cours de maintenance, nous revenons bientôt.", "Site en construction", "Ce nom de domaine est à vendre.", "Activez JavaScript dans votre navigateur.", "Cette application a besoin de JavaScript.", "Votre navigateur a bloqué les scripts de cette page.", "Le contenu ne peut pas s'afficher sans scripts.", "Retour à la page d'accueil",
]
#: Words of the usual filler text.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
#: Stand-in sentences of themes and page builders.
STAND_INS = [
    "Add your heading text here", "Your title goes here", "Your heading here", "Headline", "Sample heading", "Section title", "Subheading", "Subtitle goes here", "Add a heading", "Click the edit button to change this text.", "I'm a paragraph. Click here to add your own text and edit me.", "Your content goes here. Edit or remove this text inline.", "Welcome to your new site. This is your first post. Edit or delete it, then start writing!",
    "Just another website", "Insert text here", "Write something here", "Describe what your company does in a few lines.", "Use this space to tell customers about your business.", "Tell visitors your story here.", "Image caption", "Photo description", "Picture caption goes here", "Button label", "Button", "Label", "Feature one Feature two Feature three", "List item 1 List item 2", "Item one", "Sample text", "Dummy text", "Example paragraph", "This is a sample page.", "This is an example paragraph.",
    "Replace this text with your own content.", "This block is a placeholder, change it before you publish.", "Replace this placeholder before the site goes live.", "Short description of the service goes here.", "Enter a short introduction here.", "Add your own text to this section.",
    "Fügen Sie hier Ihre Überschrift ein", "Hier steht ein Beispieltext.", "Ersetzen Sie diesen Text durch Ihren eigenen Inhalt.", "Platzhalter", "Beschreiben Sie hier Ihr Angebot in wenigen Zeilen.", "Añada aquí su título", "Este es un texto de ejemplo.", "Sustituya este texto por su propio contenido.", "Describa aquí su servicio en pocas líneas.", "Ajoutez votre titre ici", "Ceci est un exemple de texte.", "Remplacez ce texte par votre propre contenu.", "Décrivez ici votre service en quelques lignes.",
]
#: Sentences in which a mark (here ◊) is in use.
IN_USE = [
    "Dear ◊,", "Hi ◊!", "Hello ◊ ◊, thanks for your order.", "Good morning ◊, welcome to our shop.", "Nice to see you again, ◊, you last came on ◊.", "Order ◊ was shipped to ◊ on ◊.", "Your cart has ◊ items worth ◊.", "Get ◊ now for just ◊!", "Save ◊ on every ◊ until ◊.", "Price: ◊", "◊ left in stock", "Only ◊ per ◊", "Phone us at ◊ or write to ◊.", "Ask for ◊ at the desk.",
    "By ◊ on ◊", "Written by ◊, ◊", "Filed under ◊", "◊ - ◊", "◊ | ◊", "◊ for ◊", "◊ in ◊", "◊ by ◊", "About ◊", "About ◊: ◊", "◊: ◊", "Shop for ◊ online", "The best ◊ in ◊", "Top ◊ near ◊", "◊ of ◊", "Displaying ◊ to ◊ of ◊ results", "Showing ◊", "Results for ◊", "Page ◊ of ◊", "Total: ◊", "Copyright ◊ ◊", "Start > ◊", "Home / ◊",
    "Welcome to ◊", "Welcome back ◊", "Thank you, ◊", "Visit us in ◊ today.", "We deliver to ◊ within ◊ days.", "Sehr geehrte ◊,", "Hallo ◊, danke für Ihre Bestellung vom ◊.", "Jetzt ◊ kaufen für nur ◊.", "Von ◊ am ◊", "Estimado ◊:", "Hola ◊, gracias por su pedido del ◊.", "Compre ◊ por solo ◊.", "Por ◊ el ◊", "Cher ◊,", "Bonjour ◊, merci pour votre commande du ◊.", "Achetez ◊ pour ◊ seulement.", "Par ◊ le ◊",
]
#: Sentences in which a mark is explained or quoted.
SPOKEN_OF = [
    "A placeholder like ◊ is filled in when the page is built.", "The tag ◊ is replaced by the name of the reader.", "In the template we write ◊, and the program puts the value in its place.", "For example, ◊ stands for the price of the product.", "If a visitor reads ◊ in a title, the template was never filled in.", "This guide shows what the variable ◊ means and how to use it.", "Type ◊ where the date should appear.", "Put ◊ into the file to show the author.", "The manual explains the mark ◊ and the engine that reads it.",
    "Programmers write ◊ for a value that is missing.", "A word such as ◊ in a page tells you that a value was never set.", "The printed form had ◊ as an example, which people were told to cross out.", "We call ◊ a merge field.", "Seeing ◊ on a live site means that something went wrong with the template.", "The syntax ◊ comes from an old template engine.", "Use the token ◊ in your mail program to insert the first name.", "In this lesson the sign ◊ means a variable.", "The error message said ◊, which tells nothing to a reader.", "Letters used to carry the text ◊ when the clerk had forgotten the name.", "In older systems the mark ◊ was used to show where a name should stand.",
    "Der Platzhalter ◊ wird durch den Namen ersetzt.", "In der Vorlage steht ◊ für das Datum.", "Das Zeichen ◊ zeigt, wo der Preis erscheinen soll.", "La etiqueta ◊ se sustituye por el nombre del lector.", "En la plantilla se escribe ◊ donde debe aparecer el precio.", "El signo ◊ indica que falta un valor.", "La balise ◊ est remplacée par le nom du lecteur.", "Dans le modèle, on écrit ◊ là où le prix doit apparaître.", "Le signe ◊ montre qu'une valeur manque.",
]
#: Prose that speaks of filler and notices.
SPOKEN_OF_NOTICES = [
    "Graphic artists fill an empty layout with lorem ipsum before the writers deliver their copy.", "When a server answers with code 500, the log usually says why.", "A shop should be usable for people who browse without JavaScript.", "The wording of an error page matters: tell people what they can do next.", "Search engines drop an address that answers with 404 for some weeks.", "In the nineties every second home page was under construction.",
]
